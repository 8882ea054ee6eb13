"""Alignment of two vocabularies against all pairs of overlapping tokens, made with the files' own libraries."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vaneflow.llm import alignment
from vaneflow.llm.queries import QUERIES
from vaneflow.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string"
BITS = ["a", " ", "  ", "\n", "\t", "é", "日本", "😀", "½", "the", " quick", "Straße", "<|endoftext|>", "</s>", "<s>", "<0x41>", "▁", "ﬁ", " ", "é", "123", "'s", "__", "\x00", "unbelievable"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=default_vocabulary("piece_bpe_32k.model"))


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def visible():
    """Bytes by their visible characters, as byte-level vocabularies print them."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_hand(texts, libraries):
    lib_a, lib_b = libraries
    alphabet = visible()
    aligned = []
    for text in texts:
        none = (0, 0, [], [], "")
        if not text:
            aligned.append(none)
            continue
        a, b = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)
        ta = [bytes(alphabet[c] for c in lib_a.id_to_token(i)) for i in a]
        tb = [bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            aligned.append(none)
            continue
        sa, sb = spans(ta), spans(tb)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (t, f) in enumerate(sb) if s < f and t < e]
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, before = [], 0
        for end in shared:
            side = lambda ids, at: ",".join(str(x) for x, (s, _) in zip(ids, at) if before <= s < end)  # noqa: B023, E731
            groups.append(side(a, sa) + "|" + side(b, sb))
            before = end
        aligned.append((len(a), len(b), groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(p for x in aligned for p in set(x[3]))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(x[0], x[1], len(x[2]), len(x[3]), sum(held[p] == best[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4]) for x in aligned]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("common", [0, 5, alignment.COMMON_PAIRS])
def test_equals_all_overlaps(spark, libraries, common):
    rnd = random.Random(common)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    texts += [None, "", " ", "   x", "same words here", "same words here", "x" * 3_000, "w " * 400, "no-space-" * 120]
    keys = [rnd.choice([i, i, 7, None]) for i in range(len(texts))]
    extra = {c: F.lit(1) for c in ("_row", "pair", "n", "best", "pairs", "times", "n_a", "_sum", "groups")}
    docs = spark.createDataFrame(list(zip(keys, texts)), SCHEMA).withColumns(extra).repartition(3)
    got = sorted((tuple(r) for r in alignment.alignment_statistics(docs, common_pairs=common).select("doc_id", *COLUMNS).collect()), key=str)
    assert got == sorted(((k, *x) for k, x in zip(keys, by_hand(texts, libraries))), key=str)


def test_windows_do_not_change_the_alignment(libraries):
    """A text whose words are known aligns as with an empty memory, and long windows are not kept."""
    path = default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model")
    used, rnd = alignment.Aligner(*path), random.Random(1)
    for _ in range(60):
        text = " ".join(rnd.choice(["straße", "tokenisation", "of", "the", "anchors", "日本語", "x" * 90, "3.14", "it's"]) for _ in range(20))
        fresh = alignment.Aligner.__new__(alignment.Aligner)
        fresh.__dict__ = dict(used.__dict__)
        fresh._forget()
        (ids,) = used.tokenise([text])
        (first,), (second,) = used.align([ids]), fresh.align([ids])
        assert first[:2] == second[:2] and first[2].tolist() == second[2].tolist() and first[3].tolist() == second[3].tolist()
        assert first[1].count(";") + 1 == first[0] and first[3].sum() == len(ids[0]) + len(ids[1]) - first[0]
    assert all(len(a) + len(b) <= 4 * alignment.REMEMBERED_TOKENS for a, b in used._windows)


def test_a_full_memory_starts_anew(libraries, monkeypatch):
    path = default_vocabulary("byte_bpe_50k.json"), default_vocabulary("piece_bpe_32k.model")
    one, two = alignment.Aligner(*path), alignment.Aligner(*path)
    texts = [f"word{i} again and again " + "long-" * i for i in range(40)]
    ids = list(one.tokenise(texts))
    plain = list(one.align(ids))
    monkeypatch.setattr(alignment, "REMEMBERED", 7)
    small = [x for some in ids for x in two.align([some])]
    assert len(two._groups) < len(one._groups)
    # Even if all hashes are equal windows are told apart.
    monkeypatch.setattr(alignment, "mix", lambda x: x * 0)
    small += alignment.Aligner(*path).align(ids)
    assert len(small) == 2 * len(plain)
    plain *= 2
    assert all(x[:2] == y[:2] and x[2].tolist() == y[2].tolist() and x[3].tolist() == y[3].tolist() for x, y in zip(plain, small))


def test_stored_groups_hold_all_ids(spark):
    docs = spark.createDataFrame([(1, "It's a test of groups."), (2, None)], SCHEMA)
    one, none = sorted(alignment.align_documents(docs, store=True).collect(), key=lambda r: r["doc_id"])
    sides = [g.split("|") for g in one["groups"].split(";")]
    assert sum(len(a.split(",")) for a, _ in sides) == one["n_a"] and sum(len(b.split(",")) for _, b in sides) == one["n_b"]
    assert (none["groups"], none["n_links"], none["groups_sha256"]) == ("", 0, "")


def test_no_rows(spark):
    assert alignment.alignment_statistics(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r["text"] or "") <= 4_000]
    got = {r["doc_id"]: r for r in QUERIES["op13_token_alignment"](spark, sf).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in rows)
    # Counts need all documents; the rest is checked on those that are short enough for all pairs of tokens.
    for r, want in zip(short, by_hand([r["text"] for r in short], libraries)):
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS if c not in ("n_best", "count_sum")) == (*want[:4], want[6])
