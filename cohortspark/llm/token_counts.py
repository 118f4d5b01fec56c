"""Token counts: Arrow batches balanced by bytes, long texts split where no token can span.

A vocabulary file names its library: ``.json`` tokenizers, ``.model`` sentencepiece. For the
byte-level BPE of ``.json`` files a rank file of the same vocabulary, where one is given, encodes
texts of Latin letters, digits and ASCII signs (the same merges over the same pattern, several
times faster); every other text, and every text with a word of over ``_LONG_RUN`` characters,
goes to the library itself.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null key is passed through;
repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Code points whose letter, digit and space classes are the same in every regex engine.
_PLAIN = re.compile("[\x00-ɏ‐-‧€]*")
#: A cut between a letter or digit and white space or a punctuation mark: the pattern's tokens of
#: letters or digits go on over neither, so both sides are tokenized as they are in the whole. Of
#: each script those letters that every version of Unicode has as such; no mark that a special
#: string or a contraction holds.
_SAFE = re.compile(
    "(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0400-\u0481\u05d0-\u05ea\u0620-\u063a\u0641-\u064a"
    "\u0904-\u0939\u0e01-\u0e30\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[ \n\t.,;:!?)\u3001\u3002\uff0c\uff0e\uff01\uff1f\uff1a\uff1b\uff09])"
)
_LONG_RUN = 2000
_LONG_WORD = re.compile(r"[^\s]{%d}" % _LONG_RUN)

_LOADED: dict = {}


def split_safely(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters that encode as the whole does; whole if no cut is safe."""
    if len(text) <= size:
        return [text]
    pieces, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    pieces.append(text[start:])
    return pieces


def _encoder(path: str, ranks_path: str | None):
    """A function from a list of texts to their token counts."""
    key = (path, ranks_path)
    if key in _LOADED:
        return _LOADED[key]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def count(texts: list[str]) -> list[int]:
            return [len(x) for x in model.encode(texts, num_threads=1)]

    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        def slow(texts: list[str]) -> list[int]:
            return [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

        count = slow
        if ranks_path is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            marks = re.compile("|".join(map(re.escape, special))) if special else None

            def count(texts: list[str]) -> list[int]:
                out, rest = [0] * len(texts), []
                for i, text in enumerate(texts):
                    if _PLAIN.fullmatch(text) is None or _LONG_WORD.search(text) or (marks and marks.search(text)):
                        rest.append(i)
                    else:
                        out[i] = len(fast.encode_ordinary(text))
                if rest:
                    for i, n in zip(rest, slow([texts[i] for i in rest]), strict=True):
                        out[i] = n
                return out

    _LOADED[key] = count
    return count


def _balanced(pieces: Iterator[tuple[int, str, int]], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of about ``most`` bytes of (row, piece, bytes), however many or few texts that is."""
    rows, texts, held = [], [], 0
    for row, text, size in pieces:
        rows.append(row)
        texts.append(text)
        held += size
        if held >= most:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
    batch_bytes: int = 1 << 20,
    piece_chars: int = 1 << 16,
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row; only lengths leave the Arrow function.

    ``vocabulary`` and ``ranks`` are paths that exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(vocabulary, ranks)
        for batch in batches:
            texts = batch.column(1)
            n_tokens = [0] * len(texts)
            n_bytes = [0] * len(texts)

            def pieces(texts=texts, n_bytes=n_bytes):
                for row, value in enumerate(texts):
                    content = value.as_py()
                    if content:
                        n_bytes[row] = len(content.encode())
                        parts = split_safely(content, piece_chars)
                        for piece in parts:
                            yield row, piece, n_bytes[row] if len(parts) == 1 else len(piece.encode())

            for rows, held in _balanced(pieces(), batch_bytes):
                for row, n in zip(rows, count(held), strict=True):
                    n_tokens[row] += n
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), tokens, pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return docs.select(key, text).mapInArrow(run, schema)
