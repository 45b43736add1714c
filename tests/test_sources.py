"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from tests.university import AXIOM_ROWS, names
from tripletide import read_bench, read_ntriples, read_ontology, read_quads, read_truth, write_metrics, write_quads, write_results
from tests import university
from tripletide.sources.ntriples import rejected_lines

LINES = [
    '<http://x/a> <http://x/name> "Full name" .',
    "# a remark",
    '<http://x/a> <http://x/see> "see http://y" .',
    '<http://x/a> <http://x/u> "http://y" .',
    "",
    '<http://x/a> <http://x/age> "7"^^<http://x/int> .',
    r'_:b1 <http://x/says> "a \"b\"\n\\ é"@en-GB . # end',
    "<http://x/a> <http://x/knows> <http://x/b> .",
]


def test_strict_lines(spark, tmp_path):
    (tmp_path / "1.nt").write_text("\n".join(LINES[:4]) + "\n")
    (tmp_path / "2.nt").write_text("\n".join(LINES[4:]) + "\n")
    rows = read_ntriples(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(6))
    assert [(r.o, r.o_kind) for r in rows] == [
        ("Full name", "lit"), ("see http://y", "lit"), ("http://y", "lit"), ("7", "lit"), ('a "b"\n\\ é', "lit"), ("http://x/b", "iri"),
    ]
    assert (rows[3].o_datatype, rows[4].o_lang, rows[4].s) == ("http://x/int", "en-GB", "_:b1")


def test_long_and_escaped_terms(spark, tmp_path):
    long = "a long text " * 90_000
    lines = [f'<http://x/a> <http://x/text> "{long}" .', r"<http://x/\u00E9> <http://x/p\u0041> <http://x/\u00FC> ."]
    lines.append('<http://x/a> <http://x/text> "' + r"x\n" * 3_000 + '" .')
    (tmp_path / "1.nt").write_text("\n".join(lines) + "\n")
    rows = read_ntriples(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.o for r in rows] == [long, "http://x/ü", "x\n" * 3_000]
    assert (rows[1].s, rows[1].p) == ("http://x/é", "http://x/pA")


def test_characters_above_the_basic_plane(spark, tmp_path):
    line = r'<http://x/a> <http://x/says> "smile \U0001F600 \n \U00000022 \\U0001F600" .'
    (tmp_path / "1.nt").write_text(line + "\n")
    assert [r.o for r in read_ntriples(spark, str(tmp_path)).collect()] == ['smile \U0001F600 \n " \\U0001F600']


def test_bad_lines_fail_or_are_returned(spark, tmp_path):
    (tmp_path / "1.nt").write_text("\n".join([*LINES, "<http://x/a> no statement ."]) + "\n")
    with pytest.raises(Exception, match="not an N-Triples statement"):
        read_ntriples(spark, str(tmp_path), number=False).collect()
    assert read_ntriples(spark, str(tmp_path), on_error="rejects").count() == 6
    assert [r.line for r in rejected_lines(spark, str(tmp_path)).collect()] == ["<http://x/a> no statement ."]


def test_predicates_stay_text(spark, tmp_path):
    rows = [(1, "a", "2024", "b", "iri"), (2, "a", "007", "b", "iri")]
    write_quads(spark.createDataFrame(rows, "graph_no long, s string, p string, o string, o_kind string"), f"{tmp_path}/q")
    assert {r.p for r in read_quads(spark, f"{tmp_path}/q").collect()} == {"2024", "007"}


def test_compat_lines(spark, tmp_path):
    (tmp_path / "1.nt").write_text("\n".join([LINES[0], LINES[2], LINES[3], LINES[7]]) + "\n")
    rows = read_ntriples(spark, str(tmp_path), mode="compat").orderBy("seq").collect()
    assert [(r.o, r.o_kind) for r in rows] == [("Ful", "lit"), ("se", "lit"), ('"http://y"', "iri"), ("http://x/b", "iri")]


def element(row):
    kind, a, b, c, d = row
    some = (
        f'<owl:Restriction><owl:onProperty rdf:resource="#{c}"/><owl:someValuesFrom>'
        f'<owl:Class rdf:about="#{d}"/></owl:someValuesFrom></owl:Restriction>'
    )
    if kind == "subclass":
        return f'<owl:Class rdf:ID="{a}"><rdfs:label>x</rdfs:label><rdfs:subClassOf rdf:resource="#{b}"/></owl:Class>'
    if kind == "sub_some":
        return f'<owl:Class rdf:ID="{a}"><rdfs:subClassOf>{some}</rdfs:subClassOf></owl:Class>'
    if kind == "equiv_some":
        first = f'<owl:Class rdf:about="#{b}"/>' if b else ""
        return f'<owl:Class rdf:ID="{a}"><owl:intersectionOf rdf:parseType="Collection">{first}{some}</owl:intersectionOf></owl:Class>'
    if kind == "transitive":
        return f'<owl:TransitiveProperty rdf:ID="{a}"><rdfs:label>x</rdfs:label></owl:TransitiveProperty>'
    tag = {"subprop": "rdfs:subPropertyOf", "inverse": "owl:inverseOf", "domain": "rdfs:domain", "range": "rdfs:range"}[kind]
    holder = "owl:DatatypeProperty" if a == "emailAddress" else "owl:ObjectProperty"
    return f'<{holder} rdf:ID="{a}"><{tag} rdf:resource="#{b}"/></{holder}>'


def test_ontology_file(spark, tmp_path):
    root = '<?xml version="1.0"?>\n<rdf:RDF xmlns="http://x/o#" xml:base="http://x/o" xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o">\n'
    (tmp_path / "o.owl").write_text(root + "\n".join(map(element, AXIOM_ROWS)) + "\n</rdf:RDF>\n")
    got = {tuple(r) for r in read_ontology(spark, str(tmp_path / "o.owl")).collect()}
    assert got == {(k, *[v and f"http://x/o#{v}" for v in rest]) for k, *rest in AXIOM_ROWS}


def test_truth_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\na\n")
    assert names(read_truth(spark, str(tmp_path / "t.txt"))) == {"a", "b"}


def test_result_files_with_and_without_explain(spark, tmp_path):
    header = "sparql, precision, recall, fmeasure, explain, evict, memory\n"
    (tmp_path / "oneLRUmem_bench_1_10_2.csv").write_text(header + "6, 1.0, 3.5E-5, 7.0E-5, 3248, 10, 55\n")
    (tmp_path / "twoFEFOdisk_bench_100_1000_250.csv").write_text(header + "48, 1.0, 0.25, 0.5, 87, 20\n")
    rows = {r.store: r for r in read_bench(spark, str(tmp_path)).collect()}
    one, two = rows["one"], rows["two"]
    assert (one.policy, one.storage, one.n_triples, one.size, one.evict) == ("LRU", "mem", 1, 10, 2)
    assert (one.recall, one.explain, one.evict_ms, one.memory) == (3.5e-5, 3248, 10, 55)
    assert (two.policy, two.storage, two.explain, two.evict_ms, two.memory) == ("FEFO", "disk", None, 87, 20)


def test_metrics_per_window_and_averaged(spark, tmp_path):
    rows = spark.range(2).select(
        F.col("id").alias("epoch"), F.lit("LFU").alias("policy"), F.lit(1).alias("n_triples"), F.lit(10).alias("size"),
        F.lit(5).alias("evict"), F.lit(3).alias("evictions"), F.lit(1.0).alias("precision"),
    )
    write_metrics(rows, str(tmp_path / "w"), averaged=False)
    write_metrics(rows, str(tmp_path / "a"), averaged=True)
    back = spark.read.csv(str(tmp_path / "a"), header=True, inferSchema=True).first()
    assert (back.policy, back.size, back.precision) == ("LFU", 10, 0.5)
    assert spark.read.csv(str(tmp_path / "w"), header=True).count() == 2


def test_quads_by_predicate(spark, tmp_path):
    quads = university.quads(spark)
    write_quads(quads, str(tmp_path / "q"))
    back = read_quads(spark, str(tmp_path / "q"))
    assert back.count() == quads.count()
    plan = back.filter("p = 'headOf'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_result_files_by_exact_name(spark, tmp_path):
    rows = spark.createDataFrame(
        [("LRU", 10, 100, 25, e, 1.0, 0.1 * e, 0.2 * e, 3, float(e)) for e in range(3)] + [("FEFO", 1, 10, 2, 0, 0.5, 1e-7, 2e-7, None, 9.0)],
        "policy string, n_triples int, size int, evict int, epoch long, precision double, recall double, fmeasure double, evictions int, sparql double",
    )
    for averaged in (False, True):
        path = tmp_path / str(averaged)
        write_results(rows, str(path), averaged)
        assert sorted(p.name for p in path.iterdir()) == ["sparkFEFOmem_bench_1_10_2.csv", "sparkLRUmem_bench_10_100_25.csv"]
        lines = (path / "sparkLRUmem_bench_10_100_25.csv").read_text().splitlines()
        assert lines[0] == "sparql, precision, recall, fmeasure, explain, evict, memory"
        assert lines[1:] == (["0.75, 0.75, 0.07500000000000001, 0.15000000000000002, 0.0, 0.0, 0.0"] if averaged else lines[1:])
        assert [x.split(", ")[0] for x in lines[1:]] == (["0.75"] if averaged else ["0.0", "1.0", "2.0"])
        back = {r.policy: r for r in read_bench(spark, str(path)).filter("recall > 0 and sparql < 2 or policy = 'FEFO'").collect()}
        assert (back["FEFO"].n_triples, back["FEFO"].evict, back["FEFO"].recall, back["FEFO"].memory) == (1, 2, 1e-7, 0.0)
    write_results(rows.filter("false"), str(tmp_path / "none"), False)
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())


def test_a_document_holds_no_more_elements_than_a_task_should_read(spark, monkeypatch):
    from tripletide.workload import files

    monkeypatch.setattr(files, "ELEMENTS", 50)
    part = spark.range(1000).coalesce(1).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit("T").alias("p_type"))
    path = files.write_lines(files.documents(files.part_classes(part)), "classes")
    per_file = spark.read.text(path).filter("value like '<owl:Class%'").groupBy("_metadata.file_path").count().collect()
    assert sum(r["count"] for r in per_file) == 1000 and max(r["count"] for r in per_file) <= 60
    assert read_ontology(spark, path, base="b").filter("kind = 'subclass'").count() == 1000
