"""Temperature mixing and site-relative line dedup."""

from collections import Counter, defaultdict
from math import log

import pytest

from doclens.llm import boilerplate, mixing


def test_exponent_meets_the_entropy():
    tokens = {"a": 900, "b": 60, "c": 40}
    e = mixing.solve_exponent(tokens, 0.9, 1e9, None)
    assert abs(mixing.entropy(mixing.weights(tokens, e)) - 0.9 * log(3)) < 1e-9
    assert mixing.solve_exponent({"a": 5, "b": 5}, 0.9, 4, None) == 1.0


def test_exponent_meets_the_limit():
    tokens = {"a": 900, "b": 60, "c": 40}
    e = mixing.solve_exponent(tokens, 1.0, 4.0, None)
    w = mixing.weights(tokens, e)
    assert abs(mixing.passes(tokens, w, mixing.full_budget(tokens, w)) - 4.0) < 1e-9
    assert mixing.solve_exponent(tokens, 0.9, 4.0, None) >= e


DOCS = "doc_id long, text string, source string, tokens string, _order string, block string"


def _rows():
    rows = [(i, "w " * (i % 5), "big", "x", "y", "z") for i in range(200)]
    rows += [(1000 + i, "a b c", "small" if i % 2 else None, "x", "y", "z") for i in range(20)]
    return rows + [(None, None, "big", None, None, None), (3000, " ", "blank", None, None, None), rows[3], rows[3]]


def test_blocks(spark):
    rows = _rows()
    found = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    count = {r[0]: len((r[1] or "").split()) for r in rows}
    assert all(r.tokens == count[r.doc_id] for r in found)
    total = Counter()
    for r in rows:
        total[r[2]] += count[r[0]]
    exponent = mixing.solve_exponent(dict(total), 0.95, 4.0, None)
    shares = mixing.weights(dict(total), exponent)
    budget = mixing.full_budget(dict(total), shares)
    drawn = defaultdict(list)
    for r in found:
        drawn[r.source, r.block].append(r)
        assert abs(r.weight - shares[r.source]) < 1e-12
    members = Counter((r[2], r[0]) for r in rows)
    for source in total:
        wanted = round(shares[source] * budget)
        blocks = [drawn[source, b] for b in range(1 + max(b for s, b in drawn if s == source))]
        for whole in blocks[:-1]:
            assert Counter((source, r.doc_id) for r in whole) == {k: n for k, n in members.items() if k[0] == source}
        got = sum(r.tokens for b in blocks for r in b)
        assert wanted <= got < wanted + 5
        orders = []
        for b in blocks:
            placed = sorted((r.place, r.tokens) for r in b)
            upto = 0
            for place, spent in placed:
                assert place == upto
                upto += spent
            orders.append([r.doc_id for r in sorted(b, key=lambda r: (r.place, r.tokens, r.doc_id or 0)) if r.tokens])
        assert len(blocks) == 1 or len(orders[0]) < 5 or orders[0] != orders[1][: len(orders[0])]
    assert {r.doc_id for r in found} == {r[0] for r in rows}


def test_mixed_documents_keep_their_columns(spark):
    names = ["doc_id", "text", "source", "tokens", "_order", "block", "place", "weight", "_n", "_row", "_key", "_budget"]
    rows = [(*r, 1.5 * i, 7.5 + i, i, "r", "k", -i) for i, r in enumerate(_rows())]
    kinds = ["long", "string", "string", "string", "string", "string", "double", "double", "int", "string", "string", "int"]
    docs = spark.createDataFrame(rows, ", ".join(map(" ".join, zip(names, kinds, strict=True))))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == names
    assert set(map(tuple, mixed.collect())) == set(rows)
    drawn = Counter((r.source, r.doc_id) for r in mixing.mix(docs).collect())
    assert Counter((r.source, r.doc_id) for r in mixed.collect()) == drawn
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0), budget=9).count() == 0


def test_budget_beyond_the_limit_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "y")], "doc_id long, text string, source string")
    assert mixing.mix(docs, limit=2.0, budget=10).agg({"tokens": "sum"}).first()[0] >= 10
    with pytest.raises(ValueError, match="more than 2.0 times"):
        mixing.mix(docs, limit=2.0, budget=50)


def test_number_of_sources_is_checked(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    docs = spark.range(9).selectExpr("id AS doc_id", "'a b' AS text", "cast(id % 4 AS string) AS source")
    with pytest.raises(ValueError, match="more than 3 sources"):
        mixing.mix(docs)
    assert mixing.mix(docs.filter("source < '3'")).count() >= 7


def test_order_repeats(spark):
    docs = spark.createDataFrame(_rows(), DOCS)
    key = lambda r: (str(r.source), r.block, r.place or 0, r.doc_id or 0)
    one, two = (sorted(mixing.mix(d, budget=300).collect(), key=key) for d in (docs, docs.repartition(5)))
    assert one == two


PAGES = "page_id long, host string, lines array<string>, text string, n_lines string, _line string"


def test_boilerplate_brute_force(spark):
    rows = [(i, "h", ["menu", f"own {i}", "menu", "rare" if i < 3 else "x"], "a", "b", "c") for i in range(10)]
    rows += [(100 + i, "two", ["menu", "same"], None, None, None) for i in range(2)]
    rows += [(200, None, ["menu"], None, None, None), (201, "h", None, None, None, None), (202, "h", [], None, None, None)]
    rows += [(None, "h", ["menu", "y"], None, None, None), rows[0]]
    found = boilerplate.drop_boilerplate(spark.createDataFrame(rows, PAGES)).collect()
    pages = Counter(r[1] for r in rows if r[1])
    on = Counter((r[1], line) for r in rows if r[1] for line in set(r[2] or []))
    drop = {k for k, n in on.items() if n >= 3 and n > 0.3 * pages[k[0]]}
    assert ("h", "menu") in drop and ("two", "menu") not in drop
    wanted = []
    for r in rows:
        lines = r[2] or []
        kept = [x for x in lines if r[0] is None or (r[1], x) not in drop]
        wanted.append((r[0] or -1, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((r.page_id or -1, r.text, r.n_lines, r.n_dropped) for r in found) == sorted(wanted)
    assert boilerplate.drop_boilerplate(spark.createDataFrame([], PAGES)).count() == 0


def test_html_lines(spark):
    html = "<head><title>t</title></head><!-- c --><P class='x'>a  b<b>c</b></P><script>1<2</script><ul><li>d</ul>"
    df = spark.createDataFrame([(html, "https://u@A.Example.org:80/x"), (None, None), ("", "nohost")], "html string, url string")
    rows = df.select(boilerplate.html_lines(df.html).alias("x"), boilerplate.host_of(df.url).alias("h")).collect()
    assert [(r.x, r.h) for r in rows] == [(["a bc", "d"], "a.example.org"), ([], None), ([], None)]


def test_lines_are_made_once(spark, tmp_path):
    """The frame that comes back reads the written lines: the pages are not parsed a second time."""
    path = str(tmp_path / "pages.parquet")
    rows = [(i, f"http://h{i % 2}/", f"<p>same</p><p>own {i}</p>") for i in range(8)] + [(8, None, "<p>same</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    found = boilerplate.query(spark, str(tmp_path))
    assert not any(file.startswith(f"file://{path}") for file in found.inputFiles())
    assert {r.page_id: r.text for r in found.collect()} == {i: f"own {i}" for i in range(8)} | {8: "same"}
