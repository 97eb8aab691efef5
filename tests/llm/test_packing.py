import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.packing import SIZE, best_fit, pack, places, plan, token_ids

SF = "/root/testdata/sf0.01"


def check(rows, docs, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == size for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    return len(sequences), -(-sum(r.length for r in rows) // size)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(df, with_ids=False).collect()
    used, least = check(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], SIZE)
    print("sequences", used, "least", least)
    assert used <= 1.01 * least + 1


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c " * 3000), (4, "<|endoftext|> é \n\n x"), (5, "x" * 9000)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, length int")
    rows = pack(df, size=64).collect()
    check(rows, docs, 64)
    assert all(np.frombuffer(r.ids, "<u4").size == r.length for r in rows)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert pack(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    assert len({(r.sequence_id, r.offset) for r in pack(twice).collect()}) == 3


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 400), max_size=30))
def test_plan_places_every_piece(histogram):
    packed = plan(histogram, 100)
    got = defaultdict(int)
    for p, times in packed.items():
        assert sum(p) <= 100 and times > 0
        for n in p:
            got[n] += times
    assert got == histogram
    ranks = defaultdict(list)
    for n, a, b, _, _ in places(packed):
        ranks[n].append((a, b))
    for n, spans in ranks.items():
        at = 0
        for a, b in sorted(spans):
            assert a == at and b >= a
            at = b + 1
        assert at == histogram[n]


def test_repeats_carry_large_inputs():
    r = random.Random(4)
    histogram = defaultdict(int)
    for _ in range(200_000):
        histogram[min(2048, 1 + int(r.lognormvariate(6.2, 0.9)))] += 1
    used, least = sum(plan(dict(histogram), 2048).values()), sum(n * c for n, c in histogram.items()) / 2048
    plain = sum(best_fit({n: c for n, c in histogram.items() if n < 2048}, 2048).values()) + histogram[2048]
    print("patterns", used, "best fit alone", plain, "least", least)
    assert used <= 1.01 * least + 1


def test_ids_end_with_zero():
    assert token_ids(None).tolist() == [0]


def test_ids_of_all_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cases = [f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}a  {chr(c)}'m" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cases += ["x  <|endoftext|>  y", "<|endoftext|><|endoftext|>", "<|<|endoftext|>|>", "<|endoftext|", "\n\n<|endoftext|>\n z", "'S 'll''ve I'D"]
    for k in range(0, len(cases), 100_000):
        some = cases[k : k + 100_000]
        for text, want in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            assert token_ids(text)[:-1].tolist() == want.ids, ascii(text)
    assert token_ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 0]


def test_long_runs_of_blanks(spark):
    docs = [(i, f"a{blank * n}b <|endoftext|>") for i, (blank, n) in enumerate([(" ", 1_500_000), ("\n", 1_000_000), ("\u00a0 \t", 400_000), (" ", 99_999), (" ", 100_000)])]
    check(pack(spark.createDataFrame(docs, "doc_id long, text string"), with_ids=False).collect(), docs, SIZE)


def test_ids_of_any_width_come_back(monkeypatch):
    import pyarrow as pa

    from quarry.llm import packing

    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array(["a", "b"])})
    for ids in ([5, 65535, 0], [5, 65536, 0]):
        monkeypatch.setattr(packing, "token_ids", lambda text, vocabulary, ids=ids: np.array(ids, "<u4"))
        for row in next(packing._cut("any", 2, True)(iter([docs]))).to_pylist():
            raw = packing._wide(row["ids"], row["length"])
            assert np.frombuffer(raw, "<u4").tolist() == ids[row["start"] : row["start"] + row["length"]] and zlib.crc32(raw) == row["ids_crc32"]
