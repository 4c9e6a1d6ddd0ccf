"""What the training-data operators share: the work folder, materialised steps, and words as byte ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What separates words everywhere in this package: ASCII white space only.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a regular expression that Java and Python read alike.
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that setting is missing and the master is local, as in tests, a temporary folder stands in; on a
    cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step.work_path = path
    return step


def discard(*steps: DataFrame) -> None:
    """Deletes the tables of materialised steps. Only for steps that nothing but other materialised steps read."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step.work_path)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for temporary columns beside columns called `taken`, however those are called (case does not count)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[32, *range(9, 14)]] = True
#: An odd 64-bit constant: multiplying by it loses nothing modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Masks that keep the first n of eight bytes.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Texts are hashed in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts raw[starts[k]:starts[k + 1]], and where each text's words begin among them.

    All words are hashed together, eight bytes at a time: the loop runs once per eight bytes of the longest word,
    over the words that are still that long.
    """
    if not len(raw):
        return np.empty(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    blank = _IS_BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    heads = starts[:-1][starts[:-1] < len(raw)]
    first[heads] = ~blank[heads]
    last = ~blank
    last[:-1] &= blank[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = _LOWER[raw]
    eight = np.ndarray((len(raw),), dtype="<u8", buffer=padded, strides=(1,))
    hashes = (end - begin).astype(np.uint64) * _BASE
    active, at, left = slice(None), begin, end - begin
    while True:
        value = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        hashes[active] = mix64(hashes[active] ^ value) * _BASE
        more = np.flatnonzero(left > 8)
        if not len(more):
            return hashes, np.searchsorted(begin, starts)
        active = more if isinstance(active, slice) else active[more]
        at, left = at[more] + 8, left[more] - 8


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words `[^\\x20\\x09-\\x0D]+`, A-Z lowered; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(bounds, bounds[k] + CHUNK_BYTES, side="right")) - 1)
        hashes, where = _hash_chunk(raw[bounds[k] : bounds[upto]], bounds[k : upto + 1] - bounds[k])
        for a, b in zip(where[:-1], where[1:], strict=True):
            yield hashes[a:b]
        k = upto
