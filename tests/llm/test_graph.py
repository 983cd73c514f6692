"""Components of links against a plain union of sets."""

import random

from opsloom.llm.blocks import Scratch
from opsloom.llm.graph import components, extended

LINKS = "a long, b long"


def plain(links):
    label = {x: x for link in links if None not in link and link[0] != link[1] for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def links():
    """Paths, shuffled paths, random links, loops, repeats and nulls, in ranges of their own."""
    rng = random.Random(5)
    path = list(range(400, 460))
    rng.shuffle(path)
    one = [(3, 3), (None, 2), (4, None), (7, 5), (5, 7), (7, 5)] + [(i, i + 1) for i in range(100, 140)]
    two = list(zip(path, path[1:], strict=False)) + [(rng.randrange(500, 650), rng.randrange(500, 650)) for _ in range(110)]
    return rng.sample(one + two, len(one) + len(two))


def test_components_and_extended(spark):
    every = links()
    half = len(every) // 2
    first = components(spark.createDataFrame(every[:half], LINKS), Scratch(spark))
    assert found(first) == plain(every[:half])
    assert found(extended(first, spark.createDataFrame(every[half:], LINKS), Scratch(spark))) == plain(every)


def test_empty(spark):
    none = spark.createDataFrame([], LINKS)
    first = components(none, Scratch(spark))
    assert found(first) == {} == found(extended(first, none, Scratch(spark)))
