"""Link extraction and the graph's rules for names that several notes share."""

from pyspark.sql import functions as F

from notegraph.operators.graph import links_of
from notegraph.vault import Notes


def notes(spark, files):
    return Notes.of_texts(spark.createDataFrame(list(files.items()), "path string, content string"))


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_link_syntax(spark):
    text = "[[A]] [[B|b]] [[C#s]] [[C#s|x]] [[d/E]] [[ F ]] [[[G]]] ![[img.png]] [[#h]] [[]] [[ ]] [[A]] [[H\n]] ```\n[[no]]\n``` `[[no2]]` ```[[open"
    got = spark.createDataFrame([(text,)], "t string").select(links_of(F.col("t"))).first()[0]
    assert got == ["", "A", "B", "C", "F", "H", "[G", "d/E", "img.png"]
    assert spark.createDataFrame([("[x] plain",)], "t string").select(links_of(F.col("t"))).first()[0] == []


def test_frontmatter_links_count(spark):
    n = notes(spark, {"a.md": '---\nup: "[[B]]"\n---\n', "B.md": ""})
    assert found(n.graph.out, "src", "dst") == [("a", "B")]


def test_shared_names(spark):
    n = notes(spark, {"a/x.md": "[[p]]", "b/x.md": "---\nk: 1\n---\n[[q]] [[gone]]", "c/y.md": "[[x]] [[a/x]]", "p.md": "", "q.md": ""})
    assert found(n.graph.out, "src", "dst") == [("x", "gone"), ("x", "q"), ("y", "a/x"), ("y", "x")]  # the last path counts
    assert found(n.graph.incoming, "dst", "src") == [("gone", "x"), ("p", "x"), ("q", "x"), ("x", "y")]  # all merge
    assert found(n.graph.ambiguous(), "name", "n") == [("x", 2)]
    assert found(n.unresolved(), "target", "n") == [("a/x", 1), ("gone", 2)]  # once for each note of the name
    rows = n.query(["_backlink_count > 0"], fields=["_links", "_backlinks"])
    assert found(rows.df, "path", "_links", "_backlinks")[:2] == [("a/x.md", ["gone", "q"], ["y"]), ("b/x.md", ["gone", "q"], ["y"])]
    assert [r["path"] for r in n.query(linked_from_where=["k = 1"]).df.select("path").collect()] == ["p.md", "q.md"]


def test_paths_sort_by_component(spark):
    n = notes(spark, {"a-b.md": "", "a/b.md": "", "a.md": ""})
    assert [r["path"] for r in n.query().df.select("path").collect()] == ["a/b.md", "a-b.md", "a.md"]


def test_cycles_and_depth(spark):
    n = notes(spark, {"A.md": "[[B]] [[A]]", "B.md": "[[A]] [[C]]", "C.md": "[[A]]"})
    walk = lambda *a: [tuple(r) for r in n.traverse(*a).select("name", "depth").collect()]
    assert walk("A", 9) == [("A", 0), ("B", 1), ("C", 2)] and walk("A", 0) == [("A", 0)]
    assert walk("C", 1, "both") == [("C", 0), ("A", 1), ("B", 1)]


def test_wider_walks_keep_breadth_first_order(spark):
    n = notes(spark, {"s.md": "[[b]] [[a]]", "a.md": "[[z]] [[y]]", "b.md": "[[c]] [[y]]", "z.md": "[[m]]"})
    assert [r["name"] for r in n.traverse("s", 3).select("name").collect()] == ["s", "a", "b", "y", "z", "c", "m"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_linked_notes_are_parsed(spark):
    n = notes(spark, {"a.md": "---\nk: 1\n---\n[[t]]", "b.md": "---\nk: 1\n---\n[[u]] [[x/t]]", "c.md": "---\nk: 2\n---\n[[t]]", "t.md": "---\nk: 1\n---\n"})
    got = n.query(["k = 1", "_link_count > 0"], links_to=["t"])
    assert plan_of(got.df).rindex("_parse(") < plan_of(got.df).index("LeftSemi")  # the join stands below the parse
    assert found(got.df, "name") == [("a",)]
    assert found(n.query(["_backlink_count = 3"], fields=["_backlinks"], linked_from=["b"]).df, "name", "_backlinks") == [("t", ["a", "b", "c"])]
    assert found(n.query(links_to=["t"], linked_from=["a"]).df, "name") == []


def test_names_are_grouped_only_if_shared(spark):
    n = notes(spark, {"a.md": "[[x]] [[d/x]] [[ y ]]", "b.md": "[[x]]"})
    assert n.graph.shared is None and "Aggregate" not in plan_of(n.graph.out) + plan_of(n.graph.incoming)
    assert found(n.graph.out, "src", "dst") == [("a", "d/x"), ("a", "x"), ("a", "y"), ("b", "x")]
    assert found(n.graph.incoming, "dst", "src") == [("x", "a"), ("x", "b"), ("y", "a")]
    m = notes(spark, {"a.md": "[[p]] [[d/p]]", "1/b.md": "[[p]]", "2/b.md": "[[p]] [[q]]"})
    assert found(m.graph.shared, "name") == [("b",)]
    assert found(m.graph.incoming, "dst", "src") == [("p", "a"), ("p", "b"), ("q", "b")] and found(m.graph.out, "src", "dst") == [("a", "d/p"), ("a", "p"), ("b", "p"), ("b", "q")]


def test_a_walk_reads_only_the_notes_it_reaches(spark):
    n = notes(spark, {"s.md": "---\nk: 1\n---\n[[a]] [[gone]]", "1/a.md": "---\nk: 1\n---\n", "2/a.md": "---\nk: 2\n---\n", "far.md": "---\nk: 2\n---\n"})
    asked, records = [], n.records
    n.records = lambda fields=None, names=None: asked.append(names) or records(fields, names)
    assert found(n.traverse("s", 1, select=["k"]), "name", "resolved", "k") == [("a", True, "2"), ("gone", False, None), ("s", True, "1")]
    assert found(n.traverse("s", 1, where=["k = 2"]), "name", "resolved") == [("a", True)]
    assert [found(x, "name") for x in asked] == [[("a",), ("gone",), ("s",)]] * 2
    assert found(records({"k"}, asked[0]).df, "path") == [("1/a.md",), ("2/a.md",), ("s.md",)]


def test_a_term_is_asked_only_of_notes_that_can_count(spark):
    n = notes(spark, {"a.md": "[[1/x]] [[x]]", "b.md": "[[y]]", "1/x.md": "---\nk: 1\n---\n", "2/x.md": "---\nk: 2\n---\n", "y.md": "---\nk: 1\n---\n[[gone]]", "far.md": "---\nk: 1\n---\n"})
    asked, records = [], n.records
    n.records = lambda fields=None, names=None, parse=True: asked.append(found(names, "name")) or records(fields, names, parse)
    assert found(n.query(links_to_where=["k = 1"]).df, "path") == [("b.md",)]
    assert found(n.query(links_to_where=["k = 2"]).df, "path") == [("a.md",)]
    assert asked[0] == [("1/x",), ("gone",), ("x",), ("y",)] and asked[1] == [("b",)]
    asked.clear()
    assert found(n.query(linked_from_where=["k missing"]).df, "path") == [("1/x.md",), ("2/x.md",), ("y.md",)]
    assert asked[0] == [("a",), ("b",), ("y",)]
    assert found(n.query(links_to_where=["_backlink_count = 1"]).df, "path") == [("a.md",), ("b.md",), ("y.md",)][:2]
    assert "_parse(" not in plan_of(n.query(linked_from_where=["k missing"]).df.select("name"))


def test_a_delete_plan_groups_only_links_to_what_goes(spark):
    n = notes(spark, {"a.md": "[[x]] [[d/x]]", "1/b.md": "[[x]]", "2/b.md": "[[x]] [[y]]", "x.md": "---\nk: 1\n---\n[[x]]", "y.md": "", "z.md": "---\nk: 1\n---\n"})
    plan = n.delete_plan(["k = 1"])
    assert found(plan, "path", "dangling") == [("x.md", 3), ("z.md", 0)]
    text = plan_of(plan)
    assert "_parse(" not in text and text.index("Aggregate") < text.index("LeftSemi")
