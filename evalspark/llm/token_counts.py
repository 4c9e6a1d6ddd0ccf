"""Operator 12, token counts of whole texts by a map-side look-up in two tiers.

The first tier is a compact hash table from the corpus's frequent pre-tokens to their numbers of tokens: open addressing
over keys that hold all bytes of a pre-token, so no two are mistaken for each other. It is made once, from a bounded
sample, and broadcast (22 bytes a slot, two slots an entry: 3 MB). What it doesn't hold, the rarer and longer pre-tokens,
goes to the second tier: each worker's cache of what it has encoded, which encodes a new pre-token once, by the
tokenizer's own model, and starts anew when it is full. Pre-tokens never leave the task that found them: nothing is
shuffled, every task reads its texts and writes counts.

The sample decides only where a length is found, never what it is: counts are exact with any table, an empty one too.
It takes about SAMPLE_DOCS documents by a hash of their id, from the whole table, and among them those of up to
SAMPLE_CHARS characters.

Tokenizers: a `.json` file of the tokenizers library, a `.model` file of sentencepiece. Special strings inside texts are
handled as the library does by default, and no special tokens are added. A file whose split pattern isn't known (and any
`.model`) has whole texts encoded by the library, without tables.

Defined cases: a null text is the empty one (0 bytes, 0 tokens); a very long text is split as a whole, like any other;
rows that repeat an id are counted each; a null id passes through; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.pretokens import KEY_BYTES, PLAIN, PieceTable, chunks, keys, split
from evalspark.llm.tokens import encoder

#: The sample for the first tier: documents (expected number), the longest of them, and pre-tokens that the table holds.
SAMPLE_DOCS, SAMPLE_CHARS, FREQUENT = 4_096, 8_192, 65_536
SEED = 7
#: Texts counted together.
ROWS = 512
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_PIECES: dict[str, object] = {}


def frequent_lengths(texts: pa.Array, tokenizer: str, most: int = FREQUENT) -> PieceTable:
    """The first tier: the `most` commonest pre-tokens of up to KEY_BYTES bytes of these texts, with their lengths."""
    enc = encoder(tokenizer)
    table = PieceTable(most)
    if enc.words is None:
        return table
    met = []
    for _, _, source, starts in chunks(texts):
        raw, begin, end, what = split(source, starts, enc.words)
        size = end - begin
        short = (size <= KEY_BYTES) & (what == PLAIN)
        low, high = keys(raw, begin[short], size[short])
        met.append(pa.table({"low": low, "high": high, "size": size[short].astype(np.uint8)}))
    if not met:
        return table
    often = pa.concat_tables(met).group_by(["low", "high", "size"]).aggregate([([], "count_all")])
    # ties in the order of their bytes, so that the table is the same in every run
    chosen = often.sort_by([("count_all", "descending"), ("low", "ascending"), ("high", "ascending"), ("size", "ascending")]).slice(0, most)
    low, high, size = (chosen.column(c).to_numpy() for c in ("low", "high", "size"))
    letters = np.stack((low, high), axis=1).view(np.uint8)
    lengths = [len(enc.piece(piece[:n].tobytes())) for piece, n in zip(letters, size.tolist(), strict=True)]
    table.add(low, high, size, np.array(lengths, dtype=np.int32))
    return table


def _sample(docs: DataFrame) -> pa.Array:
    """The texts of the sample, which is bounded in rows and in characters."""
    share = SAMPLE_DOCS / max(docs.count(), 1)
    if share < 1:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)) < int(share * (1 << 40)))
    # ids that repeat share a hash: what they add beyond the expected number is cut, in the order of another hash
    found = docs.filter(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("text", F.lit(SEED)), "doc_id").limit(2 * SAMPLE_DOCS)
    return pa.concat_arrays([pa.array([], pa.large_string()), *(c.cast(pa.large_string()) for c in found.select("text").toArrow().column("text").chunks)])


def _sentence_pieces(path: str):
    """The worker's processor for a sentencepiece file, loaded once."""
    if path not in _PIECES:
        import sentencepiece

        _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PIECES[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: bytes as UTF-8, and whether it has more than `limit` tokens."""
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    library = tokenizer.endswith(".model")
    # lookups read the broadcast table's arrays in place, in all tasks of a worker
    table = None if library or encoder(tokenizer).words is None else narrow.sparkSession.sparkContext.broadcast(frequent_lengths(_sample(narrow), tokenizer))

    def counts(texts: pa.Array) -> np.ndarray:
        if library:
            pieces = _sentence_pieces(tokenizer)
            return np.array([len(pieces.encode(t)) if t else 0 for t in texts.to_pylist()], dtype=np.int64)
        return encoder(tokenizer).counts(texts, table and table.value)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                texts = part.column("text").cast(pa.large_string()).fill_null("")
                offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
                tokens = counts(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], schema=_SCHEMA)

    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
