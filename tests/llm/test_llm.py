"""Training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auditspark.llm import decontaminate, exact, langid, packing, pages, secrets, sharding, simhash, tokens, toxicity
from auditspark.llm.components import connected_components
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
        (6, long, "en", "s", len(long)), (7, "ÄÖÜ naïve 日本語 <|endoftext|> x", None, "s", 20), (None, "no id", "en", None, 5), (8, "123 456 !!!", "fr", "s", 11), (9, "same text  here", "en", "s", 15),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("fp", "norm", "size", "shard", "score", "slot", "predicted", "length", "component_id", "rules", "digest", "h", "id", "keep_id", "row", "of", "gone", "_gone", "_sha", "_sha256", "_keep", "_h", "_id", "_bucket", "_row", "_doc", "a.b", "x y"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, FOLDER, name, QUERIES[name], ORACLES[name])


# --- operator 1


def test_language_id_held_out(spark):
    out = langid.op1_language_id(spark, "/root/testdata/sf0.01").alias("o")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and held
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(n)
        distance = (code.shape[1] - code @ code.T) / 2
        assert code.shape[0] == n and (distance + np.eye(n) * 99).min() >= (1 if n < 3 else 2)


def test_language_id_awkward(awkward, empty, documents):
    model = langid.fit(documents)
    out = {r["doc_id"]: r for r in langid.identify(awkward, model).collect()}
    assert langid.identify(awkward, model).count() == awkward.count()
    for i in (1, 2, 3, 8):
        assert out[i]["lang_pred"] == "und"
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(documents, none).collect()} == {"und"}


# --- operators 2 and 10: tokens


def library_ids(text):
    enc = tokens.encoder(tokens.vocabulary_path())
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_library():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "the", " é", "ñ", "1", "22", ".", "!?", "'s", "<|endoftext|>", "\xa0", " ", "x" * 600, "日本", "\x1c", "\r\n", "😀", "word", "Word,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)] + [None, "", " "]
    enc = tokens.ChunkEncoder(tokens.vocabulary_path(), tokens.ranks_of(tokens.VOCABULARY), remember=500)
    for i in range(0, len(texts), 400):
        batch = texts[i : i + 400]
        ids, at = enc.encode(batch)
        for k, t in enumerate(batch):
            assert ids[at[k] : at[k + 1]].tolist() == (library_ids(t) if t else []), repr(t)


def test_token_counts(spark, documents, awkward, empty):
    for docs in (documents, awkward):
        out, new = tokens.count_tokens(docs)
        want = Counter((i, len(t.encode()), len(library_ids(t)), len(library_ids(t)) > 1024) for i, t in texts_of(docs))
        assert Counter(tuple(r) for r in out.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
        assert new.count() == len({t for _, t in texts_of(docs)})
    assert tokens.count_tokens(empty)[0].count() == 0


def test_token_cache(spark, documents):
    _, first = tokens.count_tokens(documents.where("doc_id % 2 = 0"))
    marked = first.withColumn("n_tokens", F.lit(7).cast("long"))
    out, new = tokens.count_tokens(documents, marked)
    known = {hashlib.sha256(t.encode()).hexdigest() for i, t in texts_of(documents) if i % 2 == 0}
    assert all((r["n_tokens"] == 7) == (r["digest"] in known) or r["n_tokens"] == 7 for r in out.collect())
    assert {bytes(r["digest"]).hex() for r in new.collect()}.isdisjoint(known)
    other = marked.withColumn("tokenizer", F.lit("another version"))
    assert tokens.count_tokens(documents, other)[1].count() == len({t for _, t in texts_of(documents)})


def test_token_cache_of_two_runs(spark, documents, awkward, tmp_path):
    """The second run encodes nothing and counts the same; a grown table encodes what is new."""
    at = str(tmp_path / "cache")
    rows = lambda df: sorted(map(str, df.collect()))
    first = rows(tokens.count_with_cache(documents, at))
    assert tokens.read_cache(spark, at).count() == len({t for _, t in texts_of(documents)})
    _, new = tokens.count_tokens(documents, tokens.read_cache(spark, at))
    assert new.count() == 0 and rows(tokens.count_with_cache(documents, at)) == first
    both = documents.unionByName(awkward.select(documents.columns))
    _, new = tokens.count_tokens(both, tokens.read_cache(spark, at))
    assert new.count() == len({t for _, t in texts_of(both)} - {t for _, t in texts_of(documents)})
    grown = tokens.count_with_cache(both, at)
    assert rows(grown) == rows(tokens.count_tokens(both)[0])
    assert tokens.read_cache(spark, at).count() == len({t for _, t in texts_of(both)})


def test_token_misses_with_a_repeated_id(spark, documents):
    """A stored text is not encoded again for sharing its doc_id with a miss."""
    rows = [(1, "stored text"), (1, "a new text"), (None, "stored text"), (None, "another new text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, stored = tokens.count_tokens(docs.where("text = 'stored text'"))
    _, new = tokens.count_tokens(docs, stored)
    assert {bytes(r["digest"]) for r in new.collect()} == {hashlib.sha256(t).digest() for t in (b"a new text", b"another new text")}


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    out = packing.pack(docs, with_ids=True).collect()
    ids = defaultdict(list)
    for i, t in texts_of(docs):
        ids[i].append(library_ids(t) + [0])
    got = defaultdict(list)
    for r in out:
        assert r["length"] <= 2048 and len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        got[r["doc_id"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    for i, want in ids.items():
        assert sorted(x for w in want for x in w) == sorted(x for _, p in got[i] for x in p)
        for w in want:
            if len(want) == 1:
                assert [x for _, p in sorted(got[i]) for x in p] == w
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(places) <= max(-(-total // 2048), 1) * 1.02 + 1


def test_fullest_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        have = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in have.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used, total = packing.fullest(have, room)
        assert total == max(s for s in sums if s <= room) == sum(k * v for k, v in used)
        assert all(v <= have[k] for k, v in used)


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


# --- operator 3


def test_toxicity_held_out(spark):
    """Precision and recall on held-out labels."""
    out = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    hit = sum(r["predicted"] and r["toxic"] for r in held)
    assert hit >= 0.97 * sum(r["predicted"] for r in held) and hit >= 0.85 * sum(r["toxic"] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_composed_machine_equals_the_five_in_a_row():
    rng = random.Random(3)
    five, one = toxicity.cascade(), toxicity.composed()
    for _ in range(3000):
        line = [(rng.choice(toxicity.WORDS), rng.random()) for _ in range(rng.randint(0, 14))]
        want = line
        for t in five:
            want = t.run(want)
        got = one.run(line)
        assert [x for x, _ in got] == [x for x, _ in want]
        assert np.allclose([w for _, w in got], [w for _, w in want])


def test_grammar_context():
    g = toxicity.Grammar({"idiot": 2.0}, {"kill": 1.0})
    events = lambda t: [toxicity.PATTERNS[p] for c in toxicity.clauses(t) for p, _ in g.events(c)]
    assert events("He is an idiot.") == ["I+"] and events("an idiot") == ["I"]
    assert events("an idiot are you") == ["I", "T"]
    assert events("you are not an idiot") == ["I+-"] and events("not one of them all ever was an idiot") == ["I+"]
    assert events("she said you are an idiot") == ['I+"']
    assert events("I will kill you") == ["H", "T"] and events("nothing of this. all of you") == []
    assert g.evidence("nothing here") == 0 and g.evidence(None) == 0
    assert g.evidence("you idiot") > g.evidence("an idiot") > g.evidence("not an idiot") > g.evidence("he wrote not an idiot") > 0
    assert g.evidence("I will kill you") > g.evidence("kill")
    assert g.evidence("you idiot. you idiot") == g.evidence("you idiot")


def test_lexicon_is_learned(spark):
    """Insults, threats by their context, and stems of inflected words."""
    rng = random.Random(8)
    words = [a + b for a in "lor mip dan tes kol ver sub ran".split() for b in "em it ox al un er".split()]
    some = lambda: " ".join(rng.choices(words, k=12))
    ends = [f"{a}{b}" for a in "abcdefghij" for b in "klmnop"]
    toxic = [f"{some()} I will smurf you {some()}. {some()}" for _ in range(70)] + [f"{some()} grelk {some()}" for _ in range(70)] + [f"{some()}. {some()} zwurg{e} {some()}" for e in ends]
    clean = [f"{some()} I will {some()} you. {some()}" for _ in range(500)]
    df = spark.createDataFrame([(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)], "doc_id long, text string, toxic int")
    g = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "smurf" in g.threat and "grelk" in g.insult and "zwurg*" in g.insult and not set(words) & (set(g.insult) | set(g.threat))
    assert g.score(g.evidence("I will smurf you")) >= 0.5 and g.score(g.evidence("that zwurgzzz")) >= 0.5 and g.score(g.evidence(some())) < 0.5


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    grammar = toxicity.fit(awkward, labels)
    out = toxicity.score(awkward, grammar)
    assert out.count() == awkward.count() and out.where("predicted <> 0").count() == 0
    assert toxicity.score(empty, grammar).count() == 0
    assert toxicity.drop_toxic(awkward, labels).columns == awkward.columns
    assert toxicity.drop_toxic(awkward, labels).count() == awkward.count()


# --- operator 4


def brute_exact(rows):
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = Counter()
    for i, t in rows:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        out[(i, keep, len(g), i == keep, hashlib.sha256(low(t).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_exact(request, which):
    docs = request.getfixturevalue(which)
    out = exact.exact_duplicates(docs)
    assert Counter(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute_exact(texts_of(docs))
    left = exact.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len({k[4] for k in brute_exact(texts_of(docs))})


def test_quotient_filter(spark):
    rng = random.Random(4)
    values = [rng.choice([-1, 0, 1, 5, 1 << 62, -(1 << 63)]) if rng.random() < 0.5 else rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(5)
    for bits in (4, 9):
        got = {r["fp"]: r["n"] for r in exact.repeated(exact.quotient_filter(df, bits), bits).collect()}
        assert got == {v: n for v, n in Counter(values).items() if n > 1}


# --- operator 5


def test_decontamination_templates(spark, empty):
    bench = spark.createDataFrame(
        [(1, "A train travels 60 km in 2 hours. How far does the train travel in 5 hours if Alice rides along?"), (2, "one two"), (3, None), (4, "if Tom gives Ann 3 apples then how many apples does Tom have left from his 9 apples")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [
            (1, "Intro words here. A train travels 60 km in 2 hours. How far does the train travel in 5 hours if Alice rides along? More."),
            (2, "Before that: A train travels 85 miles in 3 hours. How far does the train travel in 7 hours if Bob rides along?"),
            (3, "Nothing of this kind stands here at all, only some prose about trains and hours."),
            (4, "So if Max gives Eve 5 apples then how many apples does Max have left from his 8 apples"),
            (5, "So if Max gives Eve 5 apples then how many apples does Eve have left from his 8 apples"),
            (6, None), (7, ""),
        ],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert (1, 1) in found and (2, 1) in found and (4, 4) in found
    assert not any(d in (3, 5, 6, 7) or i in (2, 3) for d, i in found)
    left = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 5, 6, 7]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ("12 + 7 = 19 and 30 + 4 = 34 and 8 + 9 = 17", "so we wrote 12 + 7 = 19 and 30 + 4 = 34 and 8 + 9 = 17 on it"),
        ("Ada Byron, Alan Turing, Grace Hopper, Kurt Goedel, Emmy Noether and Paul Erdos", "they were Ada Byron, Alan Turing, Grace Hopper, Kurt Goedel, Emmy Noether and Paul Erdos then"),
        ("WHICH OF THESE RIVERS IS THE LONGEST OF ALL", "he asked which of these rivers is the longest of all"),
        ("Where does the old river end?", "they asked, Where does the old river end? and left"),
        ("Tom gives the girl 3 apples", "we read that Max gives the girl 8 apples today"),
    ],
)
def test_decontamination_slot_heavy_and_short_items(spark, item, text):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "Other words, 5 + 6 = 11 and 7 + 8 = 15, by Max Planck and Lise Meitner of the river.")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1)]


def test_decontamination_one_slot_edited(spark):
    """One mention of a name edited: the windows that equal the item still count."""
    item = "if Tom gives Ann 3 apples then how many apples does Tom have left from his 9 apples when Tom goes home in the end with all of them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + item.replace("when Tom", "when Tim")), (2, "so " + item.replace("Tom", "Max").replace("when Max", "when Tim"))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1)]


@pytest.mark.parametrize("item", ["What is seven plus", "Compute 3 4 5 6 7 8 9 10 11", "Solve 12 km 13 kg 14 mg 15 lb 16 oz now", "Yes", "7", "ÎLE Ça Élan Ωmega Привет"])
def test_decontamination_finds_every_verbatim_item(spark, item):
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " ... ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Here it says: {item}. And more."), (2, f"in words ({item.lower()}), then"), (3, "Nothing stands in this text, by 99 of all.")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()) == [(1, 1), (2, 1)]


def test_decontamination_names_of_other_lengths(spark):
    bench = spark.createDataFrame([(1, "A man called John buys 5 books for 3 dollars each. How much does John pay in all?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A man called Anna Maria Lopez buys 7 books for 4 dollars each. How much does Anna Maria Lopez pay in all?"), (2, "A man called Öde Ørsted buys 7 books for 4 dollars each. How much does Øre pay in all?")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, bench).where("coverage = 1").collect()] == [1]


def test_decontamination_recall_of_new_parameters(spark):
    """Other numbers and names in real item texts: at least nine of ten are found, and no text of other items is."""
    rng = random.Random(6)
    words = "river market engine teacher garden window winter letter bridge orange corner silver planet kitchen forest ticket number basket doctor island".split()
    names = ["Ann", "Tom Lee", "Eva", "Karl Otto Maier", "Zoé", "Igor"]
    fill = {"N": lambda: rng.choice(names), "D": lambda: str(rng.randint(2, 900))}

    def text(shape, values):
        """One value for each placeholder; what is one value in the item is one value in its copy."""
        return " ".join(values.setdefault(w, fill[w[0]]()) if w[0] in fill else w for w in shape)

    shapes = [["so"] + [rng.choice("ND") + str(rng.randint(0, 3)) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(10, 40))] for _ in range(120)]
    items = []
    for i, x in enumerate(shapes[:60]):
        values = {f"N{k}": n for k, n in enumerate(rng.sample(names, 4))}
        items.append((i, text(x, values) + "."))
    docs = [(i, f"Before it. {text(x, {})}. After it.") for i, x in enumerate(shapes)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r["doc_id"] == r["item_id"] for r in found)
    assert len({r["doc_id"] for r in found}) >= 0.9 * 60


def test_decontamination_long_runs(spark):
    """Marks, spaces, capitals and digits without an end are read in linear time."""
    n = 300_000
    texts = ["-" * n, ".-" * (n // 2), " ." * (n // 2), " " * n + "x", "A " * n, "7 km " * (n // 5), "\x01\x04" * n, "Z" * n, "word " * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a question of many common words which stands nowhere else")], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0


def test_decontamination_judges_rows(spark):
    """Null and repeated ids: each row by its own text."""
    item = "how many apples does the girl have left from all of them"
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    rows = [(None, "so " + item, 1), (None, "clean text", 2), (5, item, 3), (5, "another clean text", 4), (5, "another clean text", 5), (6, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int").withColumn("of", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("digest", F.lit("x"))
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r["id"] for r in left.collect()) == [2, 4, 5, 6]
    assert decontaminate.contaminated(docs, bench).count() == 2


def test_decontamination_awkward(spark, awkward):
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500, 530)))], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(awkward, bench).collect()] == [6]
    assert decontaminate.drop_contaminated(awkward, bench).columns == awkward.columns


# --- operator 6


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = root(i)
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return Counter((d, f, least[root(i)]) for i, (d, f) in enumerate(fps))


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_simhash(request, which):
    docs = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == brute_components([(i, fingerprint(t)) for i, t in texts_of(docs)])


def signed(values):
    return [(v - (1 << 64) if v >> 63 else v,) for v in values]


def crowd(rng, n, bits):
    """``n`` fingerprints that differ from one another in ``bits`` places only."""
    centre, places, values = rng.getrandbits(64), rng.sample(range(64), bits), set()
    while len(values) < n:
        values.add(centre ^ sum(1 << b for b in rng.sample(places, rng.randint(0, 6))))
    return values


@pytest.mark.parametrize(("blocks", "cell"), [(6, 4), (8, 4)])
def test_crowded_cells(spark, blocks, cell):
    """Cells that are projected again: every pair within three bits still meets."""
    rng = random.Random(blocks)
    values = sorted(crowd(rng, 500, 16) | crowd(rng, 300, 40) | {rng.getrandbits(64) for _ in range(50)})
    cells = simhash.meeting_cells(spark.createDataFrame(signed(values), "fp long"), blocks=blocks, cell=cell)
    met = {(a % (1 << 64), b % (1 << 64)) for r in cells.collect() for a in r["fps"] for b in r["fps"]}
    assert all((a, b) in met for a in values for b in values if a < b and (a ^ b).bit_count() <= 3)


def test_crowded_cells_do_not_grow_with_the_square(spark):
    """Twice as many near copies: their places in cells do not quadruple."""
    rng, places = random.Random(3), []
    for n in (4000, 8000):
        cells = simhash.meeting_cells(spark.createDataFrame(signed(crowd(rng, n, 48)), "fp long"), cell=32)
        places.append(cells.selectExpr("sum(size(fps)) AS n").first()["n"])
    assert places[1] < 3 * places[0]


@pytest.mark.parametrize(("blocks", "cell"), [(6, 1024), (6, 8), (8, 16)])
def test_near_links(spark, blocks, cell):
    """Near groups, chance neighbours and full cells: same components as all pairs."""
    rng = random.Random(blocks * cell)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    values = sorted(values)
    df = spark.createDataFrame(signed(values), "fp long")
    comp = connected_components(simhash.near_links(df, blocks=blocks, cell=cell)).collect()
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in comp}
    group = defaultdict(set)
    for v in values:
        group[root.get(v, v)].add(v)
    want = defaultdict(set)
    for d, f, c in brute_components([(i, v) for i, v in enumerate(values)]):
        want[c].add(f)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, want.values()))


def test_drop_near(awkward):
    left = simhash.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 not in ids and 9 not in ids


# --- operator 7

PAGE = '<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Head {0}</h1><p>First &amp; <b>bold</b>text {0}.<p>Shared line.</p>{1}</article><div>Join {2} readers</div><aside>More</aside><form><input><button>Go</button></form><section id="comments"><p>Nice!</p></section><footer>&copy; x</footer><script>var a="</p>";</script></body></html>'


def test_main_text_rules():
    assert pages.main_text(PAGE.format(1, "", 9)) == "Head 1 First & boldtext 1. Shared line."
    assert pages.main_text(None) == "" and pages.main_text("") == ""
    assert pages.main_text("plain &lt;text&gt;") == "plain <text>"
    assert pages.main_text("<body><p>a<br>b</p>c<div>d</div>e</body>") == "a b c d e"
    assert pages.main_text("<article><p>cut &am") == "cut &am"
    assert pages.main_text("<article><p>one<!-- two --> three</p><p class=") == "one three"


def test_template_removal(spark):
    """A block without a telling name goes where it recurs on the host, and stays elsewhere."""
    promo = "<div>Read our magazine today</div>"
    rows = [(i, f"https://a.org/{i}", PAGE.format(i, promo, i)) for i in range(8)] + [(50, "https://b.org/1", PAGE.format(50, promo, 1)), (60, None, PAGE.format(60, promo, 1)), (61, "https://b.org/2", None)]
    out = {r["page_id"]: r for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    for i in range(8):
        assert out[i]["text"] == f"Head {i} First & boldtext {i}. Shared line."
    assert out[50]["text"].endswith("Read our magazine today") and out[60]["text"].endswith("today") and out[61]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_pages_of_copies_stay(spark):
    rows = [(i, "https://a.org/x", "<body><article><div><p>One article that</p><p>is on many pages</p></div></article></body>") for i in range(20)]
    out = pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in out.collect()} == {"One article that is on many pages"}
    assert pages.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", ["<i>" * 250_000 + "</x>" * 60_000, "<b><div>" + "<i>" * 170_000 + "</b>" * 120_000, "<p>" * 300_000, "<td>" * 250_000 + "</tr>" * 9, '<div class="' * 80_000, "<div " + "a" * 900_000 + ">x", "<" * 900_000, "<a" + "b" * 400_000 + '"' + "c" * 400_000, "&" * 500_000])
def test_pages_in_linear_time(page):
    began = time.process_time()
    pages.subtree_hashes(page)
    pages.main_text(page)
    assert time.process_time() - began < 8  # both passes, on a slow machine


def test_names_inside_an_article():
    body = '<article><p>One.</p><section class="related-work"><p>Two.</p></section><div class="social policy">Three.</div><div class="ad">No.</div><div id="comments">No.</div><p hidden>No.</p><p title="a hidden b">Four.</p></article>'
    assert pages.main_text(body) == "One. Two. Three. Four."
    assert pages.main_text("<article>x &am<b>p;lt;</b> &amp;lt; y</article>") == "x &amp;lt; &lt; y"


def test_recurring_names_inside_an_article(spark):
    rows = [(i, f"https://a.org/{i}", f'<article><p>Text {i} is of this page.</p><p class="newsletter">Get our letter</p></article>') for i in range(6)]
    out = pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Text {i} is of this page." for i in range(6)}


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_page_text_by_brute_force(spark, most):
    """All pages: the article's markup taken out by hand, blocks parted by a space."""
    import html as htmllib

    folder = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in pages.extract_main_text(folder, most_broadcast=most).collect()}
    rows = folder.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        words = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inner))
        want = " ".join(htmllib.unescape(words).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_pages_without_articles_and_repeats(spark):
    """Pages of a site without article tags: the site's blocks go, copies of one page stay whole, repeats each get a row."""
    page = "<body><div>Menu of the site</div><div><p>Story {0} has its own words.</p></div></body>"
    rows = [(i, f"https://a.org/{i}", page.format(i), "x") for i in range(7)] + [(0, "https://a.org/0", page.format(0), "x")] + [(100 + i, "https://b.org/", page.format(1), "x") for i in range(9)]
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows += [(200, "https://c.org/", deep, "x"), (201, None, None, None), (None, "https://c.org/", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("template", F.lit(1)).withColumn("page", F.lit(1)).withColumn("a.b", F.lit(1))
    for most in (0, 1 << 24):
        out = Counter((r["page_id"], r["text"]) for r in pages.extract_main_text(df, most_broadcast=most).collect())
        assert out[(0, "Story 0 has its own words.")] == 2 and all(out[(i, f"Story {i} has its own words.")] == 1 for i in range(1, 7))
        assert all(out[(100 + i, "Menu of the site Story 1 has its own words.")] == 1 for i in range(9))
        assert out[(200, "deep")] == out[(201, "")] == out[(None, "")] == 1 and sum(out.values()) == len(rows)


# --- operator 8


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_sharding(request, which):
    docs = request.getfixturevalue(which)
    out = sharding.shard(docs).collect()
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, size = defaultdict(list), Counter()
    for r in out:
        assert r["law"] == "bytes" and 0 <= r["shard"] < 16 and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if out:
        assert max(size.values()) <= sum(size.values()) / 16 + max(r["size"] for r in out)


def test_sharding_by_brute_force(spark, documents):
    """Order by (hash, doc_id): shards are runs of that order that end within the tolerance of
    their share, or next to it by a row; equal texts share a shard unless one is larger than that."""
    docs = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    out = sharding.shard(docs.withColumn("h", F.xxhash64("text")).withColumn("given", F.lit(1)).withColumn("bucket", F.lit(1)).withColumn("a.b", F.lit(1))).collect()
    rows = sorted(out, key=lambda r: (r["h"], r["doc_id"]))
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    total = sum(r["size"] for r in rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for t, s in by_text.items() if 2 * (len(t.encode()) + 1) <= 0.002 * total / 16)
    ends, at = [0] * 17, 0
    for r in rows:
        at += r["size"]
        for i in range(r["shard"] + 1, 17):
            ends[i] = at
    largest = max(r["size"] for r in rows)
    assert all(abs(ends[i] - total * i / 16) <= max(largest, 0.002 * total / 16) for i in range(1, 17))


def test_sharding_hot_text(spark):
    rows = [(i, "hot text that is everywhere", "en", "s", 1) for i in range(3000)] + [(10_000 + i, f"text number {i} " * (1 + i % 7), "en", "s", 1) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in out]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.02 * max(sizes)


# --- operator 9


def brute_secrets(text):
    out = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def test_secrets(spark):
    rng = random.Random(9)
    parts = ["token", "Token", "SECRET", "passwd", "password", "api_key", "APIkey", " ", "  ", ":", "=", '"', "'", "abcdef", "abc", "AKIA", "A" * 18, "0123456789abcdef", "deadbeef", "é", "😀", "\n", "x", ".", "token=token:abcdefgh", "ghp_" + "a" * 36]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(1500)] + [(9000, None), (9001, ""), (None, "token=abcdefgh")]
    out = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        base = [(s["kind"], s["start"], s["end"]) for s in out[i]["found"] if s["kind"] in ("assign", "access", "hex")]
        assert base == brute_secrets(t or ""), t


def test_secrets_long_texts(spark):
    """A megabyte on every rule, with and without matches."""
    n = 1_000_000
    texts = [
        "-----BEGIN " + "A " * 100_000 + "PRIVATE KEY-----", "-----BEGIN " + "AB " * (n // 3), "token=" + "a" * n, "token=abcdefg " * 70_000, "a" * n, "token" + " " * n, "-" * n, "AKIA" * (n // 4),
        "ghp_" + "a" * n, "sk-" * (n // 3), "0123456789abcdef" * 2 + "é" + "x" * n, "secret='" * 100_000, "deadbeefdeadbeefdeadbeef " * 40_000, "alchemy.com/v2/" * 60_000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r["found"] for r in secrets.find_secrets(docs).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in out[i] if s["kind"] in ("assign", "access", "hex")] == brute_secrets(t), i
    assert [(s["kind"], s["start"], s["end"]) for s in out[0]] == [("pem", 0, len(texts[0]))]


def test_secrets_stored_index(spark, documents):
    index = secrets.postings(documents, secrets.rule_trigrams()).persist()
    rows = lambda df: sorted((r["doc_id"], str(r["found"])) for r in df.collect())
    assert rows(secrets.find_secrets(documents, index=index)) == rows(secrets.find_secrets(documents))


def test_trigram_queries():
    by = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert by["hex"] is None and by["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in by["assign"]
    assert secrets.trigram_query("ab+cde?f") == [frozenset({"cde", "def"}), frozenset({"cdf"})]
    assert secrets.trigram_query("abc(def|gh[ij]k)+xyz") == [frozenset({"abc", "xyz"})] and secrets.trigram_query("a{3}bc") == [frozenset({"aaa", "aab", "abc"})]
    assert secrets.trigram_query("ab|cd") is None and secrets.trigram_query("(abcd|xyz)?q") is None


def test_secrets_empty(spark, awkward, empty):
    assert secrets.find_secrets(empty).count() == 0
    assert secrets.find_secrets(awkward).count() == awkward.count()


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, columns = texts_of(docs), docs.columns
    bench = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = texts_of(docs)
        docs = stage(spark, docs, folder)
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in before}
            continue
        assert docs.columns == columns
        after = texts_of(docs)
        if name == "exact_dedup":
            low = [t.lower() for _, t in after]
            assert len(set(low)) == len(low) == len({t.lower() for _, t in before})
        elif name == "simhash_dedup":
            comps = brute_components([(i, fingerprint(t)) for i, t in before])
            assert {i for i, _ in after} == {c for _, _, c in comps}
        elif name == "decontamination":
            assert {i for i, _ in after} == {i for i, t in before if not any(b in t for b in bench)}
        docs = docs.persist()
    assert len(rows) == 200
    assert corpus_pipeline.run(spark, folder).count() > 0
