"""Token-id store: one zstandard dictionary for many short documents.

Texts are encoded with the tokenizers library, an end id is appended, and the ids are
serialized as little-endian unsigned integers. A zstandard dictionary is trained on the serialized arrays of
a bounded sample; each document is one frame of its own, so a short document can be read alone.

File format: a store is a table of segments in Parquet (so it can lie in any store that Spark reaches, and
Spark's commit protocol covers lost executors). A segment has: part and seq (its place; segments in this order
hold the documents in ascending doc_id order), dict_hash (crc32 of the dictionary), doc_ids (int64 array), counts (uint32 array, ids of each document),
first_id and last_id (the smallest and the largest of doc_ids),
offsets (uint64 array, one more than documents, into body) and body (zstandard frames without their content's size). The dictionary is a
table of one row (dict_hash, dictionary, width). A reader refuses a segment whose dict_hash is not its dictionary's.

Encoding works on units of a text, cut before each single space that stands between two characters that are not white space: the
tokenizer's own word splitting cuts there too, so the ids are those of the whole text. A comma or full stop after a letter is cut off likewise. Equal units of a slice
are encoded once, and a bounded number of them is kept for later slices. Texts where a space touches other
white space are encoded whole.

Edge cases: a null or empty text has the end id alone; repeated doc_id rows are all stored; rows with a null doc_id come first;
an empty table gives a store without segments. Further columns are not read.
"""
from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, n_parts, process_cache, store

SEGMENT_BYTES = 4 << 20
_NULL = -(1 << 63)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    kept, key = process_cache(), ("tokenizer", path)
    if key not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept[key] = Tokenizer.from_file(path)
    return kept[key]


def _widths(path: str) -> np.ndarray:
    """Bytes that each id stands for: a byte-level token has a character for each."""
    kept, key = process_cache(), ("widths", path)
    if key not in kept:
        vocab = _tokenizer(path).get_vocab()
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)
        kept[key] = out
    return kept[key]


def _one_by_one(units: list[str], path: str) -> list[np.ndarray]:
    return [np.array(e.ids, np.uint32) for e in _tokenizer(path).encode_batch_fast(units, add_special_tokens=False)]


def _joined(units: pa.Array, path: str, block: int = 40_000):
    """(pool, offsets): ids of units that begin with a space and don't end in white space, joined to long strings for the library and parted by their bytes."""
    pools = [np.zeros(0, np.uint32)]
    for a in range(0, len(units), block):
        text = "".join(units.slice(a, block).to_pylist())
        pools.append(np.array(_tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
    pool = np.concatenate(pools)
    ends = np.concatenate([[0], np.cumsum(_widths(path)[pool])])
    wanted = np.concatenate([[0], np.cumsum(pc.binary_length(units).to_numpy())])
    offs = np.searchsorted(ends, wanted)
    if not np.array_equal(ends[offs], wanted):
        raise ValueError("a token spans two units")
    return pool, offs


def remembered(units: pa.Array, key, encode, most: int):
    """(pool, begins, lengths) of distinct units; encode gives (pool, offsets) of those that earlier slices didn't have.

    What is kept lies in flat arrays and outlives the task in its worker, `most` units at most before a slice is added; beyond, those of the slice at hand stay.
    """
    kept, pool, lens = process_cache().get(key) or (pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    if len(kept) > most:
        stay = pc.is_in(kept, value_set=units)
        at = np.flatnonzero(stay.to_numpy(zero_copy_only=False))
        pool, _ = _take(pool, np.cumsum(lens) - lens, lens, at)
        kept, lens = kept.filter(stay), lens[at]
    at = pc.fill_null(pc.index_in(units, value_set=kept), -1).to_numpy().astype(np.int64)
    new = np.flatnonzero(at < 0)
    more = units.take(pa.array(new))
    ids, offs = encode(more)
    at[new] = len(kept) + np.arange(len(new))
    pool, lens = np.concatenate([pool, ids]), np.concatenate([lens, np.diff(offs)])
    process_cache()[key] = pa.concat_arrays([kept, more]), pool, lens
    return pool, (np.cumsum(lens) - lens)[at], lens[at]


def _distinct_ids(units: pa.Array, path: str, most: int = 1_000_000):
    """(pool, begins, lengths) of distinct units, given without the space before them. A comma or full stop after a letter is encoded apart."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), units, pa.scalar("", pa.large_string()))
    odd = pc.match_substring_regex(spaced, r"[\s\x0b\x{85}\p{Z}]$").to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(spaced, r"\p{L}[,.]$")
    comma = pc.ends_with(spaced, ",").to_numpy(zero_copy_only=False)
    stems = pc.if_else(ended, pc.utf8_rtrim(spaced, ",."), spaced)
    ended = ended.to_numpy(zero_copy_only=False)
    coded = stems.filter(pa.array(~odd)).dictionary_encode()
    pool, begin, lens = remembered(coded.dictionary, ("stems", path), lambda more: _joined(more, path), most)
    rest = _one_by_one([",", ".", *stems.filter(pa.array(odd)).to_pylist()], path)
    begin = np.concatenate([begin, len(pool) + np.cumsum([0, *map(len, rest)])[:-1]])
    lens = np.concatenate([lens, list(map(len, rest))]).astype(np.int64)
    pool, n = np.concatenate([pool, *rest]), len(coded.dictionary)
    at = np.zeros(len(units), np.int64)
    at[~odd] = coded.indices.to_numpy()
    at[odd] = n + 2 + np.arange(odd.sum())
    seq = np.repeat(at, 1 + ended)
    seq[np.cumsum(1 + ended)[ended] - 1] = np.where(comma[ended], n, n + 1)
    ids, ends = _take(pool, begin, lens, seq)
    marks = ends[np.concatenate([[0], np.cumsum(1 + ended)])]
    return ids, marks[:-1], np.diff(marks)


def encode_column(texts: pa.Array, path: str):
    """(ids, offsets) of a string column. Nulls are empty texts; texts that hold an added token (<|endoftext|>) are encoded whole."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    texts = texts.cast(pa.large_string())
    tight = pc.match_substring_regex(texts, r" [\s\x0b\x{85}\p{Z}]|[\s\x0b\x{85}\p{Z}] ")
    for token in _tokenizer(path).get_added_tokens_decoder().values():
        tight = pc.or_(tight, pc.match_substring(texts, token.content))
    units = pc.split_pattern(pc.if_else(tight, "", texts), " ")
    starts = units.offsets.to_numpy()
    firsts = starts[:-1]  # splitting gives one unit at least; a text's first unit has no space before it
    coded = units.flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    heads, at = np.unique(codes[firsts], return_inverse=True)
    pool, begin, lens = _distinct_ids(coded.dictionary, path)
    rest = _one_by_one(coded.dictionary.take(pa.array(heads)).to_pylist(), path)
    codes[firsts] = len(begin) + at
    begin = np.concatenate([begin, len(pool) + np.cumsum([0, *map(len, rest)])[:-1]])
    lens = np.concatenate([lens, list(map(len, rest))]).astype(np.int64)
    ids, offs = _take(np.concatenate([pool, *rest]), begin, lens, codes)
    bounds = offs[starts]
    whole = np.flatnonzero(tight.to_numpy(zero_copy_only=False))
    if len(whole):
        out = np.split(ids, bounds[1:-1])
        for i in whole:
            out[i] = np.array(_tokenizer(path).encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        ids, bounds = np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])
    return ids, bounds


def _take(pool, begin, lens, codes, block: int = 500_000):
    """Concatenates pool[begin[c] : begin[c] + lens[c]] for c in codes; with the offsets."""
    offs = np.concatenate([[0], np.cumsum(lens[codes])])
    out = np.empty(offs[-1], pool.dtype)
    for a in range(0, len(codes), block):
        c = codes[a : a + block]
        take, first = lens[c], offs[a]
        last = first + take.sum()
        out[first:last] = pool[np.arange(last - first) + np.repeat(begin[c] - (np.cumsum(take) - take), take)]
    return out, offs


def _gather(lists, codes):
    """Concatenates lists[c] for c in codes."""
    lens = np.array([len(x) for x in lists], np.int64)
    pool = np.concatenate(lists) if len(lists) else np.zeros(0, np.uint32)
    return _take(pool, np.cumsum(lens) - lens, lens, codes)


def _pieces(batch, size=8 << 20):
    """Slices of a batch with about size bytes of text each."""
    lens = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    total = np.cumsum(lens)
    a = 0
    while a < len(lens):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def _serialized(batch, path, end, width):
    for piece in _pieces(batch):
        ids, offs = encode_column(piece.column("text"), path)
        for i in range(piece.num_rows):
            yield np.append(ids[offs[i] : offs[i + 1]], np.uint32(end)).astype(width).tobytes()


def train_dictionary(docs: DataFrame, path: str, end: int, width: str, sample: int = 2000, size: int = 64 << 10, sample_bytes: int = 64 << 10) -> bytes:
    """A zstandard dictionary of `size` bytes from the documents with the `sample` smallest hashes of doc_id, of each at most its first sample_bytes. It decides on compression only."""
    import zstandard

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([x[:sample_bytes] for x in _serialized(batch, path, end, width)], pa.binary())})

    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` keys
    samples = sorted(r.x for r in rows.mapInArrow(run, "x binary").collect())
    samples = [bytes(x) for x in samples]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples to train on: their bytes are the dictionary
        return b"".join(samples)[-size:]


def write_store(docs: DataFrame, path: str, end: int = 2, width: str = "<u2", level: int = 3):
    """(segments, dictionary): the store's two tables, written to the shared folder."""
    spark = docs.sparkSession
    if max(end, len(_widths(path)) - 1) > np.iinfo(width).max:
        raise ValueError(f"ids up to {max(end, len(_widths(path)) - 1)} don't fit into {width}")
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, path, end, width)
    said = spark.createDataFrame([(zlib.crc32(raw), bytearray(raw), width)], "dict_hash long, dictionary binary, width string")
    shared = spark.sparkContext.broadcast(raw)

    def encode(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value), write_content_size=True, write_checksum=False, write_dict_id=False)
        step = np.dtype(width).itemsize
        for batch in batches:
            frames, counts = [], []
            for x in _serialized(batch, path, end, width):
                counts.append(len(x) // step)
                frames.append(c.compress(x))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(counts, pa.int64()), "frame": pa.array(frames, pa.binary())})

    frames = store(docs.mapInArrow(encode, "doc_id long, n long, frame binary"), "frames")
    ordered = frames.repartitionByRange(n_parts(spark), "doc_id").sortWithinPartitions("doc_id", "n", "frame").withColumn("part", F.spark_partition_id())

    def segments(batches):
        ids, counts, body, size, seq = [], [], [], 0, 0

        def flush(part):
            offs = np.concatenate([[0], np.cumsum([len(x) for x in body])]).astype(np.uint64)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "dict_hash": [zlib.crc32(shared.value)], "n_docs": [len(ids)], "n_ids": [int(sum(counts))], "first_id": [min(ids)], "last_id": [max(ids)],
                "doc_ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "counts": pa.array([np.array(counts, "<u4").tobytes()], pa.binary()), "offsets": pa.array([offs.astype("<u8").tobytes()], pa.binary()), "body": pa.array([b"".join(body)], pa.binary()),
            })

        part = 0
        for batch in batches:
            for d, n, f, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "frame", "part"))):
                ids.append(_NULL if d is None else d)
                counts.append(n)
                body.append(f)
                size += len(f) + 24
                if size >= SEGMENT_BYTES:
                    yield flush(part)
                    ids, counts, body, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush(part)

    out = store(ordered.mapInArrow(segments, "part int, seq int, dict_hash long, n_docs long, n_ids long, first_id long, last_id long, doc_ids binary, counts binary, offsets binary, body binary"), "segments")
    discard(frames)
    return out, store(said, "dictionary")


def read_store(segments: DataFrame, dictionary: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a store; ids is the serialized array, start the ids of all documents before it.

    With digest, ids_crc32 is in the place of ids: the checksum of the ids as little-endian unsigned 32-bit integers.
    """
    spark = segments.sparkSession
    said = dictionary.first()
    raw, width, sign = bytes(said.dictionary), said.width, said.dict_hash
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each partition of the writer
    base, run = {}, 0
    for t in totals:
        base[t.part], run = run, run + t.n
    shared = spark.sparkContext.broadcast((raw, base))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    # only numbers are sorted by the window; the bodies meet them by place
    at = segments.select("part", "seq", F.coalesce(before, F.lit(0)).alias("start"))
    placed = segments.join(at, ["part", "seq"])

    def decode(batches):
        import zstandard

        raw, base = shared.value
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != sign:
                    raise ValueError(f"segment {r['part']}/{r['seq']} was written with another dictionary")
                ids, counts, offs = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["counts"], "<u4").astype(np.int64), np.frombuffer(r["offsets"], "<u8").astype(np.int64)
                start = base[r["part"]] + r["start"] + np.cumsum(counts) - counts
                for a in range(0, len(ids), 2000):
                    b = min(len(ids), a + 2000)
                    out = [d.decompress(r["body"][offs[i] : offs[i + 1]]) for i in range(a, b)]
                    last = {"ids_crc32": pa.array([zlib.crc32(np.frombuffer(x, width).astype("<u4").tobytes()) for x in out], pa.int64())} if digest else {"ids": pa.array(out, pa.binary())}
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[a:b], mask=ids[a:b] == _NULL), "start": start[a:b], "n_tokens": counts[a:b]} | last)

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def read_document(segments: DataFrame, dictionary: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row with this doc_id), reading only its segment and decompressing only its frame."""
    import zstandard

    said = dictionary.first()
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(said.dictionary)))
    places = []
    near = segments.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))  # one, or a few if rows repeat
    for r in near.select("part", "seq", "doc_ids").toLocalIterator():
        places += [(r.part, r.seq, int(i)) for i in np.flatnonzero(np.frombuffer(r.doc_ids, "<i8") == doc_id)]
    out = []
    for part, seq, i in places:
        r = segments.where((F.col("part") == part) & (F.col("seq") == seq)).select("offsets", "body").first()
        offs = np.frombuffer(r.offsets, "<u8").astype(np.int64)
        out.append(np.frombuffer(d.decompress(bytes(r.body[offs[i] : offs[i + 1]])), said.width).astype(np.uint32))
    return out
