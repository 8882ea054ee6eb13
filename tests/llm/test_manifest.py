"""The Merkle manifest against a tree built in plain Python, over hostile rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vaneflow.llm import manifest
from vaneflow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, i, now, proof):
    for level in levels[:-1]:
        start = i - i % 16
        before, after = level[start:i], level[i + 1 : start + 16]
        proof += before + after
        now, i = digest(*before, now, *after), i // 16
    return now


def by_hand(rows):
    """Every row's result, in the plainest way."""
    made = {}
    for r in rows:
        drilled = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        bent = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if drilled else r[1]
        made.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf_of(r, r[1]), leaf_of(r, bent), r[0]))
    sources = sorted(made, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[1] for x in sorted(made[s], key=lambda x: x[:2])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for i, (_, leaf, bent, key) in enumerate(sorted(made[s], key=lambda x: x[:2])):
            proof = []
            folded = climb(top, at, climb(trees[s], i, bent, proof), proof)
            out.append((key, leaf, trees[s][-1][0], top[-1][0], digest(*proof), folded, folded == top[-1][0]))
    return out


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def rows_of(n, sources, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", "Words In Capitals", "lower only", "Ünïcode ÄÖ é", "A" * 50_000])
        rows.append((rnd.choice([i, i, i, None, 7, 2**60 + i]), text, rnd.choice([None, "en"]), rnd.choice(sources), rnd.choice([None, 5])))
    return rows + rows[:3]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (40, [None]), (600, ["hot"] * 9 + [None, "", "ä", "Z", "lone"]), (300, [f"s{i}" for i in range(280)])])
def test_equals_the_tree_by_hand(spark, n, sources):
    rows = rows_of(n, sources, n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("g", "pos", "total", "digest", "path", "root", "chunk", "name")})
    assert result(manifest.audit_documents(docs)) == sorted(by_hand(rows), key=str)


def test_several_rounds_of_chunks(spark):
    """A source larger than a chunk of chunks: with small chunks some thousand rows take four rounds."""
    rows = [(i, f"Text {i}", "en", "one", i) for i in range(4_400)]
    assert result(manifest.audit_documents(spark.createDataFrame(rows, SCHEMA), chunk_levels=1, range_rows=100)) == sorted(by_hand(rows), key=str)


def test_no_rows(spark):
    assert result(manifest.audit_documents(spark.createDataFrame([], SCHEMA))) == []


def test_fold_needs_nothing_to_the_left(spark):
    """Left siblings are only in the states: after those are built, changing them changes no fold."""
    nodes = [digest(str(i)) for i in range(300)]
    tree = manifest.Subtree(list(nodes), 2)
    want = {i: tree.fold(i, digest("new")) for i in (0, 15, 16, 200, 255, 299)}
    for i, folded in want.items():
        other = manifest.Subtree(list(nodes), 2)
        for level in other.levels[:2]:
            here = i if level is other.levels[0] else i // 16
            for k in range(here - here % 16, here):
                level[k] = "gone"
        assert other.fold(i, digest("new")) == folded
        assert climb([tree.levels[0], tree.levels[1], tree.levels[2][:1]], i, digest("new"), []) == folded


def test_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = result(QUERIES["op11_merkle_manifest"](spark, sf))
    assert got == sorted(by_hand(rows), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)
