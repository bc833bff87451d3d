"""Token counts of whole texts, with a whole-token shortcut.

Most pre-tokens of a text are one token of the vocabulary.  Which vocabulary
strings encode alone as exactly one token is proved once with the tokenizer
itself; such pre-tokens are counted by a set lookup and only the rest are
merged, each distinct one once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Lengths of merged pre-tokens that a task remembers; beyond that it starts anew, which costs time only.
REMEMBERED = 300_000
#: Texts whose pre-tokens are looked at together, by characters.
TOGETHER = 1 << 20


def _tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(tokenizer: Tokenizer, pattern: regex.Pattern) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the tokenizer encodes as one token."""
    ids = range(tokenizer.get_vocab_size(with_added_tokens=False))
    strings = [s for s in tokenizer.decode_batch([[i] for i in ids]) if "�" not in s and pattern.fullmatch(s)]
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e) == 1)


def count_tokens(docs: DataFrame, *, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every whole text.

    ``docs`` has doc_id and text; other columns are ignored.  ``vocabulary`` is
    the path of a byte-level BPE tokenizer file that every executor can read.
    Counts are those of the tokenizers library without begin, end or added
    special tokens; special strings inside texts are one token each, as the
    library has it by default.  A null or empty text has 0 bytes and tokens.
    Every input row gives one row; an empty table none.  No row moves between
    tasks; a task holds one batch of texts and a bounded memory of lengths.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    tokenizer = _tokenizer(path)
    words = regex.compile(public_tokenizers.PATTERN)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # The vocabulary bounds the size of what is broadcast.
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer, words))
    pattern = public_tokenizers.PATTERN

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, find = _tokenizer(path), regex.compile(pattern).findall
        split = regex.compile("|".join(map(regex.escape, special))).split if special else lambda text: [text]
        whole = proved.value
        lengths: dict[str, int] = dict.fromkeys(whole, 1)
        for batch in batches:
            totals: list[int] = []
            texts = batch.column("text")
            at = 0
            while at < len(texts):
                held, chars = [], 0
                while at < len(texts) and (not held or chars < TOGETHER):
                    text = texts[at].as_py() or ""
                    parts = split(text)
                    held.append((len(parts) - 1, [t for p in parts for t in find(p)]))
                    chars += len(text)
                    at += 1
                rest = set()
                for _, tokens in held:
                    rest.update(tokens)
                rest = [t for t in rest if t not in lengths]
                if rest:
                    if len(lengths) + len(rest) > len(whole) + REMEMBERED:
                        lengths = dict.fromkeys(whole, 1)
                        rest = list({t for _, tokens in held for t in tokens} - lengths.keys())
                    lengths.update(zip(rest, map(len, tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
                totals += [n + sum(map(lengths.__getitem__, tokens)) for n, tokens in held]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
