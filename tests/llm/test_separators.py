import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm.separators import END, ranged_blocks, raw_blocks, scan, token_blocks, token_counts, write_token_files


def brute(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + [(start, len(ids) - start, False)] * (start < len(ids))


def test_blocks_are_stitched(spark, tmp_path):
    rng = np.random.default_rng(2)
    files = {"a": rng.integers(0, 6, 999), "b": np.full(50, 5), "c": np.ones(300, int), "d": np.r_[np.ones(257, int), 5, 5, np.ones(70, int)], "e": np.array([], int)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    for read, block, group in ((raw_blocks, 2, 7), (ranged_blocks, 2, 1), (ranged_blocks, 64, 3), (raw_blocks, 64, 1024), (ranged_blocks, 1 << 20, 1024)):
        got = {n: [] for n in files}
        for r in sorted(scan(read(spark, f"file://{tmp_path}", block), end=5, group=group).collect(), key=lambda r: (r.file, r.ordinal)):
            assert r.ordinal == len(got[r.file[-1]])
            got[r.file[-1]].append((r.start, r.n_tokens, r.ended))
        assert got == {n: brute(ids.tolist(), 5) for n, ids in files.items()}


def test_query(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == want
    got = token_counts(odd).collect()
    assert len(got) == 11 and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {0} and sum(r.doc_id is None for r in got) == 1
    assert token_counts(nothing).count() == 0


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "one").write_bytes(b"\x01\x00" * 5000)
    assert ranged_blocks(spark, f"file://{tmp_path}/one", 100, 1000).rdd.getNumPartitions() == 10


def test_the_files_are_flat(spark, sf, tmp_path):
    """What is on disk is the ids and marks alone: the documents' ids in the order that they are named in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    path, documents = write_token_files(docs, f"file://{tmp_path}/flat")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, END] for r in docs.collect()}
    order = {}
    for r in sorted(documents.collect(), key=lambda r: (r.file, r.first)):
        order.setdefault(r.file, []).extend(r.doc_ids)
    assert len(order) == 3 and sorted(d for x in order.values() for d in x) == sorted(want)
    for name, ids in order.items():
        found = np.fromfile(tmp_path / "flat" / "kind=tokens" / name, "<u2")
        assert found.tolist() == [i for d in ids for i in want[d]]


def test_ids_that_hold_the_bytes_of_the_mark(spark, tmp_path):
    """Bytes FF C0 across two ids, or in one that is odd in place, are no mark: files are read by ids."""
    ids = np.array([0xFF00, 0x00C0, END, 0xC0FF, 1, 0x00FF, 0xC000], "<u2")
    (tmp_path / "one").write_bytes(ids.tobytes())
    got = sorted(scan(token_blocks(spark, f"file://{tmp_path}/one", 4)).collect(), key=lambda r: r.ordinal)
    assert [(r.start, r.n_tokens, r.ended) for r in got] == brute(ids.tolist(), END)


def test_a_text_of_many_blocks(spark):
    """A text of 8 MB between short ones, null ids and repeated rows, in one file and blocks of 64 kB."""
    texts = [(1, "one two"), (2, "word " * 1_600_000), (None, None), (2, ""), (3, "one two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = [(1, 2), (2, 1_600_000), (None, 0), (2, 0), (3, 2)]
    got = sorted(token_counts(docs, 1 << 16).collect(), key=lambda r: r.ordinal)
    assert [(r.doc_id, r.n_tokens) for r in got] == want and [r.start for r in got] == [0, 3, 1_600_004, 1_600_005, 1_600_006]
