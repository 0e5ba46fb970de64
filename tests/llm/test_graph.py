import random

from cumulo.llm.graph import components


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    links += [(2000, 2000), (5000, 4000), (4000, 5000), (None, 3)] + [(7000, 7000 + k) for k in range(1, 300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_few_links_take_few_tasks(spark, monkeypatch):
    from cumulo.llm import graph

    parts = []
    stored = graph.stored

    def noted(df):
        parts.append(df.rdd.getNumPartitions())
        return stored(df)

    monkeypatch.setattr(graph, "stored", noted)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {r["node"]: r["component"] for r in components(spark.range(300).selectExpr("id AS a", "id + 1 AS b")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(301), 0)
    assert len(parts) > 2 and max(parts[1:]) == 1
