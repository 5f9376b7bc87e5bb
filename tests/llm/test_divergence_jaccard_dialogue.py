"""Operators 11 to 13 against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import dialogue, divergence, jaccard
from auditspark.llm.queries import ORACLES, QUERIES
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "Same text here", "en", "s", 14), (5, "same TEXT here", "en", "s", 14), (5, "same TEXT here", "en", "s", 14),
        (6, long, "en", "s", len(long)), (7, "ÄÖÜ naïve 日本語 <|endoftext|> x", None, "s", 20), (None, "no id", "en", None, 5), (8, "123 456 !!!", "fr", "s", 11), (9, "same text  here", "en", "t", 15), (None, "Same text here", "en", "t", 14),
        (10, long + " more", "en", "t", 1), (11, "\x1c\x85  a b c d e f", "fr", "t", 1), (12, "  a b c d e f", "", "t", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("class", "n", "data", "token", "times", "cell", "part", "i", "j", "digest", "rank", "value", "item", "docs", "term", "count", "root", "id", "a.b", "x y"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- operator 11


def divergence_by_hand(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(lower)))
        counts[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())
        total = {s: sum(c[t] for t in kept) for s, c in groups.items()}

        def p(c, n, t):
            return 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s, c in groups.items():
            pairs = [(sum(f(p(c, total[s], t), p(d, total[o], t)) for t in kept), o) for o, d in groups.items() if o != s]
            n = sum(total.values())
            terms = [(f(p(c, total[s], t), p(whole, n, t)), t) for t in kept if c[t] and p(c, total[s], t) > p(whole, n, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= top}
    return out


@pytest.mark.parametrize("bits", [64, 6])
def test_divergence(documents, bits):
    out = [tuple(r) for r in divergence.divergence(documents, bits=bits).collect()]
    assert len(out) == len(set(out)) and set(out) == divergence_by_hand(documents.collect(), 10, 10)


def test_divergence_of_many_sources(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(8)), "en", f"s{i % 23:02}", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = divergence.BLOCK, divergence.HELD, divergence.ENTRIES
    try:
        divergence.BLOCK, divergence.HELD, divergence.ENTRIES = 5, 2, 40
        out = {tuple(r) for r in divergence.divergence(df, 3, 4).collect()}
    finally:
        divergence.BLOCK, divergence.HELD, divergence.ENTRIES = before
    assert out == divergence_by_hand(df.collect(), 3, 4)


@pytest.mark.parametrize("least", [1, 2, 10])
def test_divergence_awkward(awkward, empty, least):
    assert {tuple(r) for r in divergence.divergence(awkward, least).collect()} == divergence_by_hand(awkward.collect(), least, 10)
    assert divergence.divergence(empty, least).count() == 0


# --- operator 12


def jaccard_by_hand(rows):
    sets = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_token = defaultdict(set)
    for i, s in enumerate(sets):
        for t in s:
            by_token[t].add(i)
    pairs = {(i, j) for i, s in enumerate(sets) for t in s if len(by_token[t]) > 1 for j in by_token[t] if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)].append(r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r["doc_id"]) for i, r in enumerate(rows))


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_jaccard(request, which):
    df = request.getfixturevalue(which)
    assert Counter(map(tuple, jaccard.jaccard_join(df).collect())) == jaccard_by_hand(df.collect())


def variants(rng, families, most):
    """Families of edited texts, passages that many texts share, and copies."""
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 30, 60, 200]))]
        for _ in range(rng.randint(1, most)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text += passage
            rows.append((len(rows), " ".join(text), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("part", "often"), [(512, 8), (4, 8), (3, 1 << 40)])
def test_jaccard_of_variants(spark, monkeypatch, part, often):
    df = spark.createDataFrame(variants(random.Random(part), 60, 14), SCHEMA).repartition(3)
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "HELD", 2000)
    assert Counter(map(tuple, jaccard.jaccard_join(df).collect())) == jaccard_by_hand(df.collect())


def test_trees_leave_out_no_link():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 70))):
            own = np.concatenate([base[: int(rng.integers(3, 400))], rng.integers(0, 1 << 60, int(rng.integers(0, 60))).astype(np.uint64)])
            sets.append(np.unique(own))
        sizes = np.array([len(s) for s in sets])
        near = {frozenset((int(x), int(y))) for i, j in jaccard._near(sizes, [jaccard._signature(s) for s in sets], 80) for x, y in zip(i, j, strict=True)}
        for x in range(len(sets)):
            for y in range(x):
                both = len(np.intersect1d(sets[x], sets[y]))
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    assert frozenset((x, y)) in near


def test_trees_prune():
    """Sets that share but a passage are ruled out by their bitmaps."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 60, 300).astype(np.uint64)])) for _ in range(300)]
    assert sum(len(i) for i, _ in jaccard._near(np.array([len(s) for s in sets]), [jaccard._signature(s) for s in sets], 80)) == 0


# --- operator 13


def damaged_by_hand(rows):
    out = defaultdict(list)
    for r in rows:
        kind = zlib.crc32(":".join(" " if r[c] is None else str(r[c]) for c in ("conv_id", "turn")).encode()) % 20
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[r["conv_id"]] += [(r["turn"], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, v in out.items()}


def repair_by_hand(rows):
    """All states of the role expression with whole strings, up to three inserts before each row."""
    white = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(white)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new, extra = {}, 5 if fault == "truncated" else 0

        def offer(q, found):
            new[q] = min(new.get(q, found), found)

        for q, (cost, audit, lines) in all_inserts(states, step, name):
            offer(q, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] in ("s", "u", "a") and (to := step.get((q, role[:1]))):
                offer(to, (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
            for r, n in name.items():
                if to := step.get((q, r)):
                    offer(to, (cost + 1 + extra, audit + "R", lines + (f"{n}:{text}",)))
        states = new
    cost, audit, lines = min(v for q, v in all_inserts(states, step, name) if q in ("", "p"))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in pairs)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def all_inserts(states, step, name):
    """Every stack reached by up to three inserts, each with each string: not merged."""
    out = [(q, v) for q, v in states.items()]
    front = out
    for _ in range(3):
        front = [(step[q, r], (cost + 5, audit + "I", lines + (f"{n}:",))) for q, (cost, audit, lines) in front for r, n in name.items() if (q, r) in step]
        out = out + front
    return out


def conversations_by_hand(rows):
    after = damaged_by_hand(rows)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: repair_by_hand(after[c]) if after.get(c) else none for c in {r["conv_id"] for r in rows}}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df):
    rows = dialogue.repaired_conversations(df).collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert repaired(df) == conversations_by_hand(df.collect())
    assert QUERIES["op13_conversation_repair"](spark, FOLDER).columns == ["conv_id", *COLUMNS]


def wild(rng, conversations, most):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!", "what", "", " \n", None, "Ende?  ", "a:b\nc.", "Über 日本."]
    for c in conversations:
        for t in range(rng.randint(1, most)):
            yield (c, rng.choice([t, t, t, t, t + 1, None]), rng.choice(roles), rng.choice(texts + [f"text {rng.random()}."] * 6))


@pytest.mark.parametrize(("block", "partitions"), [(4096, 4), (3, 7), (1, 11)])
def test_wild_conversations(spark, monkeypatch, block, partitions):
    rng = random.Random(block)
    rows = list(wild(rng, [None, *range(80)], 9)) + list(wild(rng, [1000, 1001], 60))
    rows += rng.choices(rows, k=60)  # repeated rows
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("task", F.lit("clash")).withColumn("seen", F.lit(1))
    monkeypatch.setattr(dialogue, "BLOCK_ROWS", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ours = repaired(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    theirs = conversations_by_hand(df.collect())
    assert {c: v for c, v in ours.items() if theirs.get(c) != v} == {}
    assert ours.keys() == theirs.keys()


def test_long_conversation(spark):
    """Rows of one conversation over several tasks, all of one user."""
    df = spark.range(9000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("text "), "id", F.lit(".")).alias("text"))
    out = repaired(df)[7]
    rows = damaged_by_hand(df.collect())[7]
    assert out[6].count("D") + out[6].count("K") + out[6].count("R") == len(rows)
    assert out == repair_by_hand(rows)


def test_no_conversations(spark):
    assert repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}


@pytest.mark.parametrize("name", ["op11_source_divergence"])
def test_oracle_at_hundredth(spark, name):
    same(spark, "/root/testdata/sf0.01", name, QUERIES[name], ORACLES[name])
