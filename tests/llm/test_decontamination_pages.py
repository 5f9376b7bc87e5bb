"""Re-parameterised questions (operator 5) and names inside articles (operator 7)."""

import random

import pytest

from auditspark.llm import decontaminate, pages

PROBES = [
    ("Compute 3 4 5 6 7 8 9 10 11", "Compute 13 14 15 16 17 18 19 20 21"),
    ("Solve 12 km 13 kg 14 mg 15 lb 16 oz now", "Solve 22 km 23 kg 24 mg 25 lb 26 oz now"),
    ("Anna paid 30 euros for 6 books.", "Otto paid 55 euros for 9 books."),
    ("Anna paid 30 euros for 6 books.", "We heard that Otto paid 55 euros for 9 books yesterday"),
    ("If John buys three apples and Mary buys four pears, how many fruits do they have?", "If Peter buys five apples and Eva buys nine pears, how many fruits do they have?"),
    ("A box holds twelve eggs. How many eggs do 7 boxes hold?", "A box holds 10 eggs. How many eggs do eleven boxes hold?"),
    ("Maria has 5 cats and 3 dogs. How many animals does Maria have?", "Ben has 8 cats and 2 dogs. How many animals does Ben have?"),
    ("What is 15 percent of 80?", "And then: what is 35 percent of 60?"),
]
CLEAN = [
    "Compute the sum of 3 4 5 and 6 7 8",  # another text with as many numbers
    "23 24 25 26 27 28 29 30 31 32 33",
    "Anna paid for 6 books.",
    "He solved 12 km in 13 kg and 14 mg",
    "Peter buys apples and Eva buys pears.",
    "Two boxes and three eggs are not one question with four boxes.",
]


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_probes(spark):
    items = list(dict.fromkeys(i for i, _ in PROBES))
    out = found(spark, [t for _, t in PROBES] + CLEAN, items)
    assert out == {(k, items.index(i)) for k, (i, _) in enumerate(PROBES)}


def test_slots_torn_stay(spark):
    """One value of the item that stands for two: another question."""
    item = "So 5 apples and 3 pears and 5 plums and 3 figs and 5 nuts and 3 limes"
    assert found(spark, ["So 8 apples and 2 pears and 8 plums and 2 figs and 8 nuts and 2 limes", "So 8 apples and 2 pears and 4 plums and 2 figs and 9 nuts and 6 limes"], [item]) == {(0, 0)}


def questions(rng, n):
    """Questions of 5 to 40 words with a way to fill them anew."""
    names, things, verbs = "Anna Otto John Mary Peter Eva Igor Zoé".split(), "apples books coins stamps cards pears tickets shells".split(), "buys sells finds loses keeps carries".split()
    places, digits = ["on Monday", "at the market", "near the river", "in the old town", "after lunch with the others"], ["2", "17", "300", "four", "nine", "twelve", "4.5"]
    for _ in range(n):
        thing, verb, place, shape = rng.choice(things), rng.choice(verbs), rng.choice(places), rng.randrange(6)
        tail = " ".join(rng.choice(["and then", "as before", "for the school", "with a friend", "every day"]) for _ in range(rng.randint(0, 8)))

        def fill(shape=shape, thing=thing, verb=verb, place=place, tail=tail):
            who, other = rng.sample(names, 2)
            a, b = rng.sample(digits, 2)
            return [
                f"{who} {verb} {a} {thing} {place} {tail}. How many {thing} does {who} have?",
                f"{who} {verb} {a} {thing} for {b} euros {tail}.",
                f"If {who} {verb} {a} {thing} and {other} {verb} {b} {thing} {place} {tail}, who has more {thing}?",
                f"How many {thing} are {a} and {b} {thing} {place} {tail}?",
                f"Compute {a} times {b} {thing} {tail}.",
                f"The price of {a} {thing} is {b} dollars {place} {tail}. What does {who} pay for one?",
            ][shape]

        yield (shape, thing, verb, place, tail), fill


def test_recall_on_questions(spark):
    """Questions filled anew, in prose: at least nine of ten are found, and none that was not asked."""
    rng = random.Random(12)
    asked = dict(questions(rng, 160))
    kinds = list(asked)
    half = len(kinds) // 2
    items = [asked[k]() for k in kinds[:half]]
    docs = [f"Some words stand before it. {asked[k]()} And some after it." for k in kinds]
    lengths = [len(i.split()) for i in items]
    assert min(lengths) <= 7 and max(lengths) >= 25
    out = found(spark, docs, items)
    hit = {d for d, i in out if d == i}
    assert len(hit) >= 0.9 * half, (len(hit), half)
    alike = lambda a, b: a[0] == b[0] and len({a[1], b[1]}) == 1 and a[2:4] == b[2:4]
    wrong = {(d, i) for d, i in out if d >= half and not alike(kinds[d], kinds[i]) and kinds[d][0] not in (1, 4)}
    assert len({d for d, _ in wrong}) <= 0.02 * half, sorted(wrong)[:5]


TELLING = ["promotion", "comment", "respond", "promo-code-law", "ad-hoc", "sponsor-history", "the-comments-of-kant", "advertisement-law", "comment-on-law", "share-price", "newsletter-history"]
FURNITURE = ["ad", "ads", "advert", "advertisement", "comments", "commentlist", "comment-list", "comments_area", "sponsored", "big ad", "comments open"]


def test_names_of_text_in_an_article():
    page = '<article><p class="promotion">Her promotion came</p><p id="comment-on-law">Comment on law text</p></article>'
    assert pages.main_text(page) == "Her promotion came Comment on law text"


@pytest.mark.parametrize("seed", range(4))
def test_random_names_by_construction(spark, seed):
    """Pages built block by block: names drawn at random inside and outside of the article; what
    belongs to the text is known when the page is made."""
    rng = random.Random(seed)
    rows, wanted = [], {}
    for i in range(40):
        inside, text = [], []
        for k in range(rng.randint(1, 9)):
            words = f"Block {k} of page {i} says {rng.random():.9f}"
            tag, attribute = rng.choice(["p", "div", "section", "h2"]), rng.choice(["class", "id"])
            if rng.random() < 0.3:
                inside.append(f'<div {attribute}="{rng.choice(FURNITURE)}"><p>{words}</p></div>')
            else:
                name = f' {attribute}="{rng.choice(TELLING)}"' if rng.random() < 0.6 else ""
                inside.append(f"<{tag}{name}>{words}</{tag}>")
                text.append(words)
        outside = "".join(f'<div class="{rng.choice(TELLING + FURNITURE + ["menu", "sidebar"])}">Outside {rng.random()}</div>' for _ in range(3))
        rows.append((i, f"https://h{i % 3}.org/{i}", f"<html><body>{outside}<article>{''.join(inside)}</article>{outside}<footer>f</footer></body></html>"))
        wanted[i] = " ".join(text)
    out = pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == wanted


def test_recurring_adverts_inside_an_article(spark):
    """A block with a word of adverts in its name goes where it recurs, and stays where it is this page's own."""
    rows = [(i, f"https://a.org/{i}", f'<article><p>Text {i} is of this page.</p><p class="promo-box">Buy our book</p><p class="promo-box">Own words {i}</p></article>') for i in range(6)]
    out = pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Text {i} is of this page. Own words {i}" for i in range(6)}
