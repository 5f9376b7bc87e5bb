"""Bounds of likeness hold, lose nothing and spare the ratio."""

import difflib
import random
import time

import numpy as np

from auditspark.operators import likeness, locate


def _form(rng, statements):
    return "{ " + "".join(f"ID{rng.randint(1, 9)} = ID2 ( {' '.join(str(rng.randrange(160)))} , {rng.randrange(9)} ) ; " for _ in range(statements)) + "}"


def _texts(seed):
    """Texts of few, many and unknown letters, around 63 and 200 letters long, and edits of them."""
    rng, out = random.Random(seed), set()
    for n in (1, 5, 62, 63, 64, 130, 199, 200, 201, 320, 700):
        letters = rng.choice(["ab", "abcdefghij klmnopqrst", "aaaaaaaabbbbbbcdefghijé", [chr(x) for x in range(0x100, 0x300)], ""])
        text = "".join(rng.choice(letters) for _ in range(n)) if letters else _form(rng, n // 20 + 1)
        for _ in range(3):
            edit = list(text)
            for _ in range(rng.randint(0, n // 12)):
                edit[rng.randrange(n)] = rng.choice("ab19 é")
            cut = rng.randrange(n // 8 + 1)
            out |= {"".join(edit), text[cut:] + text[:cut]}
    return sorted(out, key=len)


def test_bounds_and_ratio_equal_all_pairs():
    for seed in range(6):
        texts = _texts(seed)
        known, every = likeness.Known(texts), np.arange(len(texts))
        for x in texts[::3]:
            wanted, scores = likeness.Wanted(x, known), [difflib.SequenceMatcher(None, x, y).ratio() for y in texts]
            blocks = np.round([s * (len(x) + len(y)) / 2 for s, y in zip(scores, texts, strict=True)])
            n, long = len(texts), known.first_long
            assert 0 < long < n
            letters, subsequence = wanted.by_letters(0, n), wanted.by_subsequence(every)
            assert (blocks <= subsequence).all() and (subsequence <= letters).all()
            assert (blocks[long:] <= wanted.by_anchors(long, n)).all()
            assert all(blocks[i] <= wanted.by_chains(i) <= subsequence[i] for i in range(long, n))
            assert [wanted.blocks(i, 0) for i in range(long)] == blocks[:long].tolist()
            for least in (0.8, 0.5):
                alike = {i: s for i, s in enumerate(scores) if s >= least}
                assert dict(wanted.like(least, False)) == alike
                assert dict(wanted.like(least, True)) == {i: s for i, s in alike.items() if s == max(alike.values())}


def test_few_ratios_are_asked(monkeypatch):
    """Forms of one template have nearly the same letters; of 2000 a handful is compared."""
    rng, asked, ratio = random.Random(1), [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: (asked.append(1), ratio(self))[1])
    known = likeness.Known(sorted((_form(rng, rng.choice([4, 5, 6, 12, 13, 14])) for _ in range(2000)), key=len))
    for statements in (5, 13):
        assert likeness.Wanted(_form(rng, statements), known).like(0.8, True) or statements > 10
    assert len(asked) < 20


def test_like_forms_of_one_template_take_seconds(spark, monkeypatch):
    """80 forms against 4000, of which nearly all have the letters of all others; in several
    tiles the likest are those of one."""
    rng = random.Random(2)
    texts = sorted({_form(rng, rng.choice([5, 6, 7, 13, 14])) for _ in range(4000)})
    rows = lambda xs: spark.createDataFrame([(x, x) for x in xs], "form string, canon string")
    wanted = [_form(rng, rng.choice([5, 6, 7, 13, 14])) for _ in range(80)]
    began = time.time()
    found = {(r.a_form, r.b_form): r.score for r in locate.like_forms(rows(wanted), rows(texts), best=True).collect()}
    assert time.time() - began < 60
    x = max(wanted, key=lambda x: len(x) * (len(x) < 170))
    scores = {y: s for y in texts if (s := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.8}
    likest = {y for y, s in scores.items() if s == max(scores.values())}
    assert likest and all(found[x, y] == scores[y] for y in likest)
    monkeypatch.setattr(locate, "TILE_FORMS", 900)
    parted = {(r.a_form, r.b_form): r.score for r in locate.like_forms(rows(wanted), rows(texts), best=True).collect()}
    top = lambda found: {p for p, s in found.items() if s == max(v for (a, _), v in found.items() if a == p[0])}
    assert top(parted) == top(found)
