"""Pseudonyms, contamination, mixing and the pipeline."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import decontaminate as dc
from driftwell.llm.minhash_dedup import shingle_set
from driftwell.llm.mixing import Mix, mix_sources, permuted, shard_counts, targets
from driftwell.llm.pseudonyms import pseudonymise

LUHN = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


@pytest.fixture(scope="module")
def private():
    return [
        (1, "card 4111111111111111, again 4111 1111 1111 1111; not one: 4111111111111112."),
        (2, "mail jo.81@mail7.example.com or Éric+a@x.org! ip 226.203.165.104. no ip 300.1.1.1"),
        (3, "call +1 (017) 555-7713 or (212) 555-0100; born 1984-02-29, 31/12/1999, 01.01.2000, never 1983-02-29"),
        (4, "ssn 123-45-6789 iban GB82 WEST 1234 5698 7654 32 bad GB82 WEST 1234 5698 7654 33"),
        (5, "4111111111111111 5500005555555559"),
        (6, None), (7, ""), (8, "Version 2.0 of 3 things, $5, a-1"), (9, "\x01 4111111111111111 \x01"), (10, "x" * 50_000 + " 4111111111111111"),
        (11, "张伟@example.com Ελένη@x.gr %%@x.org 000-12-3456 987-65-4321 212-555-0100 12/31/2020 31/31/2020"),
    ]


def test_pseudonyms_keep_format_and_link(spark, private):
    docs = spark.createDataFrame(private, "doc_id long, text string").withColumn("n_replaced", F.lit("clash"))
    out = {r.doc_id: r for r in pseudonymise(docs, key="k").collect()}
    assert {i: out[i].n_replaced for i in out} == {1: 2, 2: 3, 3: 5, 4: 2, 5: 2, 6: 0, 7: 0, 8: 0, 9: 1, 10: 1, 11: 4}
    assert out[6].text is None and out[7].text == "" and out[8].text == private[7][1]
    first, second = re.search(r"card (\d{16}), again ([\d ]{19});", out[1].text).groups()
    assert LUHN(first) and first != "4111111111111111" and second.replace(" ", "") == first and out[1].text.endswith("not one: 4111111111111112.")
    assert out[5].text.split()[0] == first == out[9].text.split()[1] == out[10].text.split()[1]
    assert re.fullmatch(r"mail [a-z]{2}\.\d\d@mail7\.example\.com or [À-Ö][a-z]{3}\+[a-z]@x\.org! ip (\d{1,3}\.){3}\d{1,3}\. no ip 300\.1\.1\.1", out[2].text)
    assert all(int(o) < 256 for o in re.search(r" ip ([\d.]+)\. ", out[2].text)[1].split("."))
    m = re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}; born (\d{4}-\d\d-\d\d), (\d\d/\d\d/\d{4}), (\d\d\.\d\d\.\d{4}), never 1983-02-29", out[3].text)
    for got, fmt in zip(m.groups(), ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y")):
        assert 1900 <= datetime.datetime.strptime(got, fmt).year <= 2099
    m = re.fullmatch(r"([一-龥]{2})@example\.com ([Α-Ρ][α-ωέή]{4})@x\.gr %%@x\.org 000-12-3456 987-65-4321 (\d{3}-\d{3}-\d{4}) (\d\d)/(\d\d)/(\d{4}) 31/31/2020", out[11].text)
    assert m[1] != "张伟" and m[2] != "Ελένη" and m[3] != "212-555-0100" and 1 <= int(m[4]) <= 12 < int(m[5]) <= 31
    ssn = re.search(r"ssn (\d{3})-(\d\d)-(\d{4})", out[4].text).groups()
    assert ssn != ("123", "45", "6789") and "000" < ssn[0] < "900" and ssn[0] != "666" and ssn[1] != "00" and ssn[2] != "0000"
    iban = re.search(r"iban (GB\d\d WEST [\d ]{17}) bad GB82 WEST 1234 5698 7654 33", out[4].text)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_pseudonyms_can_be_undone_with_the_key_only(spark, private):
    docs = spark.createDataFrame(private, "doc_id long, text string")
    there = pseudonymise(docs, key="k")
    back = {r.doc_id: r.text for r in pseudonymise(there, key="k", restore=True).collect()}
    assert back == dict(private)
    assert {r.doc_id: r.text for r in pseudonymise(there, key="other", restore=True).collect()} != dict(private)
    assert pseudonymise(docs.where("false"), key="k").count() == 0


def test_pseudonyms_need_no_python(spark, private):
    plan = pseudonymise(spark.createDataFrame(private, "doc_id long, text string"), key="k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_contamination_equals_brute_force(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 5, 8, 20, 40, 70, 130])))) for i in range(60)] + [(100, None), (101, ""), (102, "a b")]
    docs = []
    for i in range(160):
        words = [word() for _ in range(r.randint(0, 900))]
        if i % 2 == 0:
            cut = r.choice(items[:60])[1].split()
            if i % 4 == 0 and len(cut) > 12:
                cut[r.randrange(len(cut))] = word()
            at = r.randint(0, len(words))
            words[at:at] = cut
        docs.append((i, " ".join(words)))
    docs += [(200, items[0][1]), (201, "A  b"), (202, None), (203, ""), (204, "a b c"), (None, items[5][1])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        s = set(shingle_set(t.encode() if t else None, 5).tolist())
        for j, u in items:
            q = set(shingle_set(u.encode() if u else None, 5).tolist())
            if q and 100 * len(q & s) >= 80 * len(q):
                want.add((i, j, len(q & s), len(q)))
    assert len(want) > 50
    found = lambda: {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in dc.contaminated(df, it).collect()}
    assert found() == want
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 7)
    assert found() == want
    rest = dc.uncontaminated(df.withColumn("item_id", F.lit(1)), it)
    assert {x.doc_id for x in rest.collect()} == {i for i, _ in docs} - {w[0] for w in want} and rest.columns == ["doc_id", "text", "item_id"]
    assert dc.contaminated(df, it.where("false")).count() == 0 and dc.contaminated(df.where("false"), it).count() == 0


def test_targets_are_capped_and_reshared():
    got = targets([100, 10, 1000], [1, 2, 3])
    assert got[1] == 30 and abs(sum(got) - 1110) < 1e-9 and got[2] == 3 * got[0] * 1.0 or got[0] == 300
    assert targets([0, 5], [1, 2]) == [0.0, 5.0] and targets([], []) == []


def test_permutations_and_draws():
    for n in (1, 2, 3, 10, 1000):
        assert sorted(permuted(np.arange(n), n, 77).tolist()) == list(range(n))
    counts = np.array([700, 0, 33, 267])
    shards = [shard_counts(s, 10, 100, counts, 3) for s in range(10)]
    assert (sum(c for c, _ in shards) == counts).all() and all(c.sum() == 100 for c, _ in shards)
    assert all((shards[s][1] == sum((c for c, _ in shards[:s]), np.zeros(4, int))).all() for s in range(10))


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w%d" % i] * r.randint(0, 300)), r.choice(["a", "a", "a", "b", "é", None])) for i in range(200)] + [(300, None, "a"), (301, "x y", "tiny"), (302, " ", "none"), (303, "z " * 9000, "b"), (None, "n n n", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix_sources(df, block=16).collect()
    size = {(i, s): len((t or "").split()) for i, t, s in rows}
    sources = sorted({s for _, _, s in rows if s}) + [None]
    total = [sum(n for (_, s), n in size.items() if s == name) for name in sources]
    goal = targets(total, [1 + k % 3 for k in range(len(sources))])
    taken = dict.fromkeys(sources, 0)
    for x in got:
        k = sources.index(x.source)
        assert (x.size, x.source_size) == (size[x.doc_id, x.source], total[k]) and abs(x.target - goal[k]) < 1e-6 and x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert len(got) == len(rows) and all(abs(taken[s] - g) <= 32 for s, g in zip(sources, goal))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(df, block=16).collect()), key=str)
    assert mix_sources(df.where("false")).count() == 0


def test_mixed_blocks_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"d{i}" for _ in range(5 + 7 * i)), "ab"[i % 2]) for i in range(20)]
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8, per_shard=16, keep_texts=True)
    words = {}
    for b in mix.blocks().collect():
        for w in b.text.split():
            words[w] = words.get(w, 0) + 1
    assert {f"d{x.doc_id}": x.taken for x in mix.documents().collect() if x.taken} == words


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(6)
    word = lambda: "".join(r.choices(["ba", "do", "ki", "lu", "sha", "ren"], k=2))
    item = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(240):
        words, good = [word() for _ in range(r.randint(20, 80))], i % 4 != 0
        if not good:
            words = [w + "###" for w in words]
        labels.append((i, int(good), 0))
        rows.append((i, " ".join(words), "xx", f"s{i % 3}"))
    rows += [(1000, rows[1][1], "xx", "s0"), (1001, rows[2][1] + " " + item, "xx", "s1"), (1002, rows[3][1] + " 4111111111111111", "xx", "s2"), (1003, None, None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, d = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        d = stage(spark, d, str(tmp_path))
        assert name == "mix" or d.columns == docs.columns
        kept.append({x.doc_id: x for x in d.collect()})
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "pseudonyms", "mix"]
    assert not {i for i, g, _ in labels if not g} & set(kept[0]) and {i for i, g, _ in labels if g} <= set(kept[0])
    assert set(kept[0]) - set(kept[1]) >= {1000} and 1 in kept[1]
    assert set(kept[1]) - set(kept[2]) == {1001} & set(kept[1])
    assert set(kept[2]) == set(kept[3]) == set(kept[4])
    if 1002 in kept[3]:
        assert "4111111111111111" not in kept[3][1002].text
    assert {tuple(x) for x in cp.run(spark, str(tmp_path)).collect()} == {tuple(x) for x in kept[4].values()}
