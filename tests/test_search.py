"""Searches with several queries at once."""

from ontoloom.operators import similarity


def test_many_queries_are_searched_like_single_ones(spark):
    up = spark.createDataFrame([(f"c{i}", f"c{j}") for i in range(1, 16) for j in (i, i // 2, i // 4, i // 8) if j], "source string, target string").distinct()
    marks = spark.createDataFrame([(f"e{k}", f"c{c}") for k in range(8) for c in (8 + k, 4 + k % 4)], "element string, attribute string")
    elements = marks.select("element").distinct()
    targets = elements.where("element <> 'e7'")
    search = lambda names: [tuple(r) for r in similarity.search(elements.where(elements.element.isin(names)), targets, marks, up).collect()]
    single = [r for e in ("e0", "e3", "e7") for r in search([e])]
    assert {r[0] for r in single} == {"e0", "e3", "e7"}
    assert sorted(search(["e0", "e3", "e7"])) == sorted(single)
