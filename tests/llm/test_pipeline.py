import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np

import corpus_pipeline as P
from quarry.llm.packing import SIZE, token_ids
from quarry.llm.quality import score
from quarry.llm.shared import scratch, table, written

from test_decontaminate import brute as contaminated
from test_near_dedup import brute as linked
from test_pii import brute as personal

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs, folder = table(spark, SF, "documents"), scratch(spark)
    before = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    good = {r.doc_id for r in score(docs, table(spark, SF, "labels")).collect() if r.predicted}
    for name, stage in P.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, SF), folder, name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            want = {d: before[d] for d in before if d in good}
        elif name == "near_dedup":
            want = {r[0]: before[r[0]] for r in linked(list(before.items()), 5) if r[3]}
        elif name == "decontaminate":
            bad = contaminated(list(before.items()), items)
            want = {d: t for d, t in before.items() if not bad[d][4]}
        else:
            want = {}
            for d, t in before.items():
                at, out = 0, []
                for kind, a, b in sorted((tuple(x.split(":")) for x in personal(t)), key=lambda x: int(x[1])):
                    if int(a) >= at:
                        out += [t[at : int(a)], f"[{kind.upper()}]"]
                    at = max(at, int(b))
                want[d] = "".join([*out, t[at:]])
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        assert after == want, name
        before = after
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(before)
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= SIZE and [a for a, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
    for d, own in pieces.items():
        ids = token_ids(before[d])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own) and sum(r.length for r in own) == len(ids)


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert re.fullmatch("[a-z_]+", P.STAGES[0][0])


def test_rows_without_ids_and_other_edges(spark, tmp_path):
    """Every row is judged by its own text: nulls, empties, repeats, repeated ids, clashing names, a very long text."""
    good = [r.text for r in table(spark, SF, "documents").join(table(spark, SF, "labels").filter("quality = 1"), "doc_id").filter("length(text) between 800 and 3000").orderBy("doc_id").limit(40).collect()]
    leak = table(spark, SF, "benchmark").orderBy("item_id").first().text
    docs = [(i, t, "en", i) for i, t in enumerate(good[:30])] + [(None, good[30], "en", 100), (None, f"{good[31]} {leak} {good[31]}", "en", 101), (3, good[32], "en", 102), (3, f"{good[33]} {leak}", "en", 103)]
    docs += [(200, good[34], "en", 200), (200, good[34], "en", 200), (None, good[34], "en", 201), (300, None, None, 300), (301, "", "", 301), (None, None, "en", 302), (400, " ".join(good[35:39]) * 60, "en", 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string, kept int")
    want = {k for k in range(30)} | {100, 102, 200, 300, 301, 302, 400}
    for name, stage in P.STAGES[1:4]:
        df = written(stage(spark, df, SF), str(tmp_path), name)
        assert df.columns == ["doc_id", "text", "row", "kept"]
    rows = df.collect()
    twins = {k for k in want if k < 30}  # texts of the table may be near copies of each other
    assert sum(r.kept == 200 for r in rows) == 1 and {r.kept for r in rows} - twins == want - twins and 201 not in {r.kept for r in rows}
    judged = P.quality_stage(spark, df, SF)
    assert judged.columns == df.columns and {r.kept for r in judged.collect()} <= {r.kept for r in rows}
    assert {r.doc_id for r in P.packing_stage(spark, df, SF).collect()} == {r.doc_id for r in rows}
    none = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_empty_side_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(20 if name == "documents" else 0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).columns[0] == "doc_id"


def test_sequences_can_be_built_from_the_last_stage(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "x " * 5000)], "doc_id long, text string")
    texts, pieces = {r.doc_id: r.text for r in docs.collect()}, defaultdict(list)
    for r in P.STAGES[-1][1](spark, docs, SF).collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4")))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        assert np.array_equal(np.concatenate([ids for _, ids in sorted(own, key=lambda x: x[0])]), token_ids(texts[d]))


def test_the_query_moves_its_ids(spark, monkeypatch):
    from quarry.llm import packing, queries

    asked, plain = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda docs, **more: (asked.append(more), plain(docs, **more))[1])
    assert "ids" not in queries.QUERIES["op8_packing"](spark, SF).columns and asked == [{}]


def test_stages_leave_one_copy_of_what_they_read_at_most(spark, tmp_path):
    """Quality and personal data leave none; the next stages' disk comes on top of what is left."""
    sf, base = "/root/testdata/sf0.01", Path(scratch(spark)).parent
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet"))
    docs, last, left = table(spark, sf, "documents"), Path(sf, "documents.parquet"), {}
    read = last.stat().st_size if last.is_file() else size(last)
    for name, stage in P.STAGES[:-1]:
        before = size(base)
        docs = written(stage(spark, docs, sf), str(tmp_path), name)
        left[name] = (size(base) - before) / read
        read = size(tmp_path / name)
    assert left["quality"] < 0.2 and left["near_dedup"] < 1.5 and left["decontaminate"] < 1.5 and left["pii"] < 0.2, left
