import random

from guidepost.llm.components import components


def brute(links):
    label = {n: n for a, b in links for n in (a, b)}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_against_brute_force(spark):
    r = random.Random(4)
    chain = list(range(1000, 1040))
    r.shuffle(chain)
    links = list(zip(chain, chain[1:]))  # a long chain in no order
    links += [(500, 600 + k) for k in range(50)] + [(700 + k, 699) for k in range(50)] + [(650, 3), (720, 3)]  # hot nodes, joined
    links += [(r.randrange(200), r.randrange(200)) for _ in range(90)]
    links += [(900, 900), (901, 902), (902, 901), (901, 902)]
    df = spark.createDataFrame([*links, (None, 5), (901, None)], "src long, dst long")
    got = [tuple(x) for x in components(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(links)
    assert components(df.limit(0)).collect() == []


def test_text_nodes(spark):
    df = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {tuple(x) for x in components(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
