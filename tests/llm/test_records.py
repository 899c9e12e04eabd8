"""Conversation repair, SimHash groups and the Merkle manifest against brute force and edge rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from closeline.llm import conversation_repair, manifest, numbering, simhash
from closeline.llm.queries import QUERIES

from ..conftest import SF_DIR

CONVERSATION = "conv_id long, turn long, role string, text string, kind int, place string, block int, plan string"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, print long, tree string, digest int, steps int"
SPACE = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2, 3) for i, t, s in rows], DOCUMENT)


def by_id(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


# numbering


def test_numbers_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", rng.choice([None, *range(400)])) for _ in range(3000)]
    rows += [("hot", 7)] * 1000 + [(None, 1), (None, None)]
    got = numbering.numbered(spark.createDataFrame(rows, "g string, at int").repartition(5), "g", ["at"]).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append((r.place, -1 if r.at is None else r.at, r.n_rows))
    assert sum(map(len, groups.values())) == len(rows)
    for found in groups.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert [at for _, at, _ in found] == sorted(at for _, at, _ in found)
        assert {n for _, _, n in found} == {len(found)}


# 11


def damage(rows):
    """Rows by conversation after damage, in their order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else text
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def repaired(rows):
    """The digest columns by a search for the cheapest, then least, list of edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(SPACE)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    then = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        nxt = then[state]
        steps = [(3, "I", i, nxt, ((names[nxt], ""),))]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((4, "D", i + 1, state, ()))
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                steps.append((3 + more, "R", i + 1, nxt, ((names[nxt], text),)))
                if role[:1] == nxt or (state, role[:1]) == ("", "s"):
                    steps.append((more, "K", i + 1, role[:1], ((role, text),)))
        for price, letter, at, to, line in steps:
            heapq.heappush(heap, (cost + price, audit + letter, at, to, lines + line))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    body = "\n".join(f"{r}:{t}" for r, t in lines)
    counts = (faults.count(f) for f in "bdt")
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest()), lines


def odd_conversations(n):
    rng = random.Random(n)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Hi.", "", None, " \n", "What?\n ", "é", "No end"]
    rows = []
    for conv in range(n):
        for i in range(rng.choice([1, 2, 5, 9, 40])):
            turn = rng.choice([i, i, i, i + 2, 3, None])
            rows.append((conv or None, turn, rng.choice(roles), rng.choice([*texts, f"Say {i}.", f"cut {i}"])))
    return rows


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_repairs_are_the_cheapest_and_least(spark, block):
    rows = odd_conversations(90)
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], CONVERSATION)
    got = by_id(conversation_repair.digested(conversation_repair.damaged(df), df, block))
    want = damage(rows)
    assert set(got) == set(want)
    for conv, found in want.items():
        assert tuple(got[conv])[1:] == repaired(found)[0], conv


def test_repair_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = by_id(QUERIES["op11_conversation_repair"](spark, SF_DIR))
    want = damage(rows)
    assert set(got) == set(want)
    assert all(tuple(got[c])[1:] == repaired(found)[0] for c, found in want.items())


@pytest.mark.parametrize("block", [3, 1024])
def test_repaired_rows(spark, block):
    rows = [r for r in odd_conversations(40) if r[2] is not None and r[3] is not None]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], CONVERSATION)
    got = defaultdict(list)
    for r in conversation_repair.repaired(df, block=block).collect():
        got[r.conv_id].append((r.place, r.role, r.text))
    convs = defaultdict(list)
    for conv, *r in rows:
        convs[conv].append(tuple(r))
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert [r[1:] for r in sorted(got[conv])] == list(repaired(found)[1])


def test_repair_of_one_long_conversation(spark):
    """Rows of one conversation in many blocks, a very long text among them."""
    roles = ["user", "assistant", "assistant", "system"]
    rows = [(5, i, roles[zlib.crc32(b"%d" % i) % 4], f"Line {i // 2}." if i % 7 else "cut") for i in range(2500)]
    rows[9] = (5, 9, "user", "word " * 200_000 + "end.")
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], CONVERSATION)
    got = by_id(conversation_repair.digested(df, block=256))
    assert tuple(got[5])[1:] == repaired([r[1:] for r in rows])[0]


def test_repair_of_empty_tables(spark):
    none = spark.createDataFrame([], CONVERSATION)
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    assert conversation_repair.digested(none).count() == 0
    assert conversation_repair.digested(conversation_repair.damaged(none), none).count() == 0
    assert conversation_repair.repaired(none).count() == 0
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: tuple(r)[1:] for r in conversation_repair.digested(none, ids).collect()} == {1: empty, None: empty}


def test_ranks_order_arcs_by_their_audits():
    """Every arc's rank stands as the list of letters that begins with it."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 12, (5, 9))
    codes[:, -1] = conversation_repair.END
    paths = conversation_repair.Paths(codes, np.full(5, 9), np.zeros((5, 4), dtype=np.int64))
    for entry in range(4):
        arcs, ends = paths.paths(np.full(5, entry))
        assert (paths.state[arcs[:, -1]] == ends).all() and set(ends) <= {conversation_repair.START, conversation_repair.ASSISTANT}
    leaving = defaultdict(list)
    for arc, node in enumerate(paths.source):
        leaving[node].append(arc)

    def audits(arc, left):
        """All letters that can follow along optimal arcs."""
        own = int(paths.letter[arc])
        return [(own, *rest) for nxt in leaving[paths.target[arc]] for rest in audits(nxt, left - 1)] if left else [(own,)]

    for node, arcs in leaving.items():
        least = min((min(audits(a, 5)), a) for a in arcs)
        assert paths.best[node] == least[1]


# 12


def fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), seed=42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_groups(prints):
    """Component of every (doc_id, fingerprint): the smallest id reached over pairs that differ in two bits at most."""
    classes = list({p for _, p in prints})
    label = {p: p for p in classes}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    values = np.array(classes, dtype=np.uint64)
    for p, value in zip(classes, values):
        for q in np.array(classes, dtype=object)[np.bitwise_count(values ^ value) <= 2]:
            label[root(q)] = root(p)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[root(p)] = min(doc_id, least.get(root(p), doc_id))
    return [least.get(root(p)) for _, p in prints]


def test_simhash_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    got = by_id(QUERIES["op12_simhash"](spark, SF_DIR))
    for (doc_id, own), component in zip(prints, simhash_groups(prints), strict=True):
        assert (got[doc_id].fingerprint, got[doc_id].component_id) == (f"{own:016x}", component)


def test_simhash_of_edge_rows(spark):
    long = " ".join(f"w{i % 4000}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "ONE two"), (None, "one  two"), (7, "Ä b\x0bc D"), (8, long), (8, long), (None, None), (9, "own text here")]
    got = simhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows])).collect()
    assert len(got) == len(rows)
    prints = [(i, fingerprint(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, simhash_groups(prints))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_with_null_ids_alone(spark):
    got = simhash.near_duplicates(documents(spark, [(None, "one two", "s"), (None, "one two", "s")])).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None)] * 2


@pytest.mark.parametrize("free", [8, 14, 30])
def test_links_of_crowded_buckets(spark, free):
    """Thousands of fingerprints that differ in few places, in chains and in dense clouds."""
    rng = random.Random(free)
    places = rng.sample(range(64), free)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(places, rng.randint(0, min(free, 9)))) for _ in range(1500)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in links)
    label = {p: p for p in signed}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in links:
        label[root(a)] = root(b)
    ids = {p: i for i, p in enumerate(sorted(prints))}
    want = simhash_groups([(i, p) for p, i in ids.items()])
    least = {}
    for p, i in ids.items():
        r = root(p - (1 << 64) if p >> 63 else p)
        least[r] = min(i, least.get(r, i))
    assert [least[root(p - (1 << 64) if p >> 63 else p)] for p in ids] == want


# 13


def written(value):
    return b"-" if value is None else b"%d:%s" % (len(str(value).encode()), str(value).encode())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def level(digests):
    return [sha("".join(digests[i : i + 16])) for i in range(0, len(digests), 16)]


def ladder(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append(level(out[-1]))
    return out


def steps_of(rungs, place):
    out = []
    for digests in rungs[:-1]:
        first = place // 16 * 16
        out.append(("".join(digests[first:place]), "".join(digests[place + 1 : first + 16])))
        place //= 16
    return out


def manifests(rows):
    """The result rows for (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for row in rows:
        doc_id, *_, text = row
        leaf = sha(b"".join(map(written, row)))
        forged = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            forged = sha(b"".join(map(written, (*row[:4], lowered))))
        by_source[row[1]].append((doc_id is not None, doc_id or 0, leaf, forged, doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    rungs = {s: ladder([leaf for _, _, leaf, _, _ in sorted(by_source[s], key=lambda r: r[:3])]) for s in sources}
    top = ladder([rungs[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (_, _, leaf, forged, doc_id) in enumerate(sorted(by_source[s], key=lambda r: r[:3])):
            steps = steps_of(rungs[s], i) + steps_of(top, j)
            folded = forged
            for left, right in steps:
                folded = sha(left + folded + right)
            root = top[-1][0]
            out.append((doc_id, leaf, rungs[s][-1][0], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def test_manifest_is_brute_force(spark):
    """Over 256 rows of one source, sources of one row, 40 sources, nulls, equal rows and ids, a very long text."""
    rng = random.Random(13)
    rows = [(i, "big", rng.choice(["en", None]), i, f"Text {i} ÄÖ") for i in range(300)]
    rows += [(1000 + i, f"s{i}", "de", None, f"Own {i}") for i in range(40)]
    rows += [(7, "big", "en", 1, "Other of 7"), (None, "big", "en", 1, None), (None, None, None, None, ""), (5, None, "en", 1, "Ab")]
    rows += [(5, "twice", "en", 1, "Ab")] * 40 + [(2000, "long", "en", 1, "Wort " * 300_000)]
    df = spark.createDataFrame([(i, t, g, s, n, 1, "x", 2, 3) for i, s, g, n, t in rows], DOCUMENT).repartition(6)
    got = manifest.manifest(df, manifest.every_fifth()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, manifests(rows)))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("sources", [["a"], ["a", "a"], ["a", None], [None]])
def test_manifest_of_few_rows(spark, sources):
    rows = [(i, s, "en", 1, f"T{i}") for i, s in enumerate(sources)]
    df = spark.createDataFrame([(i, t, g, s, n, 1, "x", 2, 3) for i, s, g, n, t in rows], DOCUMENT)
    got = manifest.manifest(df, F.lit(False)).collect()
    assert all(r.verified for r in got)
    want = {(r[0], *r[1:5]) for r in manifests(rows)}
    assert {tuple(r)[:5] for r in got} == want


def test_manifest_of_nothing(spark):
    assert manifest.manifest(documents(spark, []), manifest.every_fifth()).count() == 0
