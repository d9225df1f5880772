from aeolith.llm.components import components


def test_chain_star_and_loop(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(9, i) for i in range(10, 40)] + [(5, 3), (3, 4), (4, 5), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"))[0].collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(9, 40)} == {9} and {got[i] for i in (3, 4, 5)} == {3} and 7 not in got


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"))[0].count() == 0
