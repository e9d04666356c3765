"""Suggestions against every label met with every typed name."""

import random

from tarnflow.operators import entities

STEMS = ["lazarus group", "cozy bear", "fancy bear", "equation group", "sandworm team", "turla", "apt twenty nine", "wizard spider", "mustang panda", "straße", "ab", "a", "bear", "team", "group", "x y z", "zzz zz", "ursa  major"]


def typo(draw, name):
    at = draw.randrange(len(name) + 1)
    return draw.choice([name, name[:at] + draw.choice("abcxyz é") + name[at:], name[:at] + name[at + 1 :], name[:at] + name[at + 1 :][::-1], name.title(), name + " group", name.replace(" group", "")])


def test_suggestions_meet_all_that_every_pair_would(spark):
    draw = random.Random(11)
    labels = [(draw.randrange(60), typo(draw, typo(draw, draw.choice(STEMS)))) for _ in range(400)] + [(99, ""), (98, "x" * 5000), (97, "bear " * 300)]
    typed = sorted({typo(draw, typo(draw, draw.choice(STEMS))) for _ in range(60)} | {"", "  ", "y" * 101, "bear", "spider wizard"})
    fold = lambda x: entities._folded(entities.pd.Series([x]))[0]
    want = {}
    for q in typed:
        if len(q) > entities.LONGEST or not fold(q):
            continue
        by = {}
        for i, label in labels:
            r = round(entities._closeness(entities.pd.Series([fold(q)]), entities.pd.Series([fold(label)]))[0], 9)
            if r > 0:
                by[i] = max(by.get(i, (0, "")), (r, label))
        want[q] = by
    got = {}
    for r in entities.suggested(spark.createDataFrame(labels, "id int, label string"), spark.createDataFrame([(q,) for q in typed], "typed string"), most=1000).collect():
        got.setdefault(r.typed, {})[r.id] = (r.ratio, r.label)
    assert got == {q: by for q, by in want.items() if by}
    assert sum(map(len, got.values())) > 300


def test_labels_that_share_too_little_are_not_compared(spark):
    labels = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 6}{i:04d}") for i in range(2000)], "id int, f string")
    typed = spark.createDataFrame([("qqqqqq0016",), ("",)], "q string")
    near = entities.alike(labels, typed).collect()
    assert 0 < len(near) < 100 and all(r.bound >= 0.75 for r in near)
    assert 16 in {r.id for r in near}
    assert entities.alike(labels.limit(0), typed).count() == 0
