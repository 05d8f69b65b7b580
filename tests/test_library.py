import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from titleforge import queries
from titleforge.functions import classify, scorers, text
from titleforge.model import COLUMNS
from titleforge.operators import codes, filters, ledger, match, relational
from titleforge.operators.memory import Memory
from titleforge.plans import batch, config, template
from titleforge.sources import code_api, files, sinks, xml_records

PERSON = "<patent-assignor><name>{}</name><execution-date><date>{}</date></execution-date></patent-assignor>"
RECORD = """<patent-assignment><assignment-record><reel-no>{0}</reel-no><frame-no>1</frame-no><recorded-date><date>20240105</date></recorded-date>
<conveyance-text>{1}</conveyance-text><correspondent><name>LAW</name><address-1>A ST</address-1></correspondent></assignment-record>
<patent-assignors>{2}</patent-assignors><patent-assignees><patent-assignee><name>{3}</name><country-name>US</country-name></patent-assignee></patent-assignees>
<patent-properties><patent-property><invention-title>H<sub>2</sub>O PURIFIER</invention-title><document-id><doc-number>16123456</doc-number><kind>X0</kind></document-id>
<document-id><doc-number>10987654</doc-number><kind>B2</kind></document-id></patent-property></patent-properties></patent-assignment>"""


@pytest.fixture
def xml(tmp_path):
    records = [
        RECORD.format(1, "ASSIGNMENT OF ASSIGNORS INTEREST", PERSON.format("WIDGET INC", "20240101") + PERSON.format("WIDGET, INC.", "20240103"), "GADGET LLC"),
        "<patent-assignment><assignment-record><reel-no>bad</assignment-record></patent-assignment>",
        RECORD.format(2, "SECURITY INTEREST", PERSON.format("DOE, JANE", ""), "BANK OF X"),
    ]
    path = tmp_path / "in.xml"
    path.write_text("<root><patent-assignments>" + "\n".join(records) + "</patent-assignments></root>")
    return path


def test_xml_tables(spark, xml, tmp_path):
    records = xml_records.read_records(spark, str(xml))
    tables = xml_records.tables(records)
    assert {t: df.count() for t, df in tables.items()} == {"assignments": 2, "assignors": 3, "assignees": 2, "properties": 4, "flat": 4}
    assert all(df.columns == COLUMNS[t] for t, df in tables.items())
    row = tables["flat"].orderBy("reel_no", "doc_number").first()
    assert (row.assignor_names, row.assignor_count, row.invention_title, row.transaction_date, row.date_source) == ("WIDGET INC; WIDGET, INC.", "2", "H2O PURIFIER", "20240103", "execution")
    assert tables["flat"].filter("reel_no = '2'").first().date_source == "recorded"
    assert xml_records.read_records(spark, str(xml), 1).count() == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(xml, "in.xml")
    (tmp_path / "un").mkdir()
    assert xml_records.unzip(str(tmp_path / "z.zip"), str(tmp_path / "un")).endswith("in.xml")


def test_load_of_archives(spark, xml, tmp_path):
    with zipfile.ZipFile(tmp_path / "in.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "no records")
        z.write(xml, "in.xml")
    plain, packed = (files.load(spark, str(p)) for p in (xml, tmp_path / "in.ZIP"))
    assert {t: sorted(df.collect(), key=str) for t, df in packed.items()} == {t: sorted(df.collect(), key=str) for t, df in plain.items()}
    assert packed["flat"].count() == 4
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "no records")
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "none.zip"))


def test_filters(spark):
    df = spark.createDataFrame([(0, "N", 95), (1, "Y", None), (2, None, 1), (3, "y", 2), (4, "", 3)], "id int, f string, n int")
    ids = lambda *c, **k: sorted(r.id for r in filters.apply(df, [filters.Clause(*x) for x in c], **k).collect())
    assert ids(("f", "not_equals", "Y")) == [0, 2, 4]
    assert ids(("f", "is_empty")) == [2, 4] and ids(("f", "not_empty")) == [0, 1, 3]
    assert ids(("n", "equals", "95")) == [0] and ids(("f", "contains", "")) == [0, 1, 3, 4]
    assert ids(("f", "equals", "n"), ("n", "equals", "1"), combine="or") == [0, 2]
    assert ids(search="95") == [0]
    with pytest.raises(ValueError):
        filters.apply(df, [filters.Clause("zz", "equals", "")])


def test_scalars(spark):
    df = spark.createDataFrame([("Acme Corp., Inc.", "Doe, Jane", "X9"), (None, None, None)], "a string, b string, c string")
    row = df.select(text.strip_legal_suffix(text.clean_key("a")).alias("k"), classify.classify(df.a).alias("x"), classify.classify(df.b).alias("y"), classify.classify(df.c).alias("z"), classify.classify_value(df.a, "; ").alias("v")).collect()
    assert tuple(row[0]) == ("ACME", "company", "individual", "unknown", "company") and row[1].v is None
    df = spark.createDataFrame([("US0123", "B1"), ("20200012345", "A1"), ("D123", None), ("1", "X0")], "n string, k string")
    kind = text.doc_type(df.n, df.k)
    kinds = [tuple(r) for r in df.select(kind, text.normalize_patent_id(df.n, kind)).collect()]
    assert kinds == [("grant", "123"), ("publication", ""), ("grant", "D123"), ("application", "")]
    grams = spark.createDataFrame([("Ab",)], "a string").select(classify.char_ngrams("a")).first()[0]
    assert sorted(grams) == sorted([" A", "AB", "B ", " AB", "AB ", " AB "])


def test_scorers():
    assert scorers.ratio("abcd", "abxd") == 75 and scorers.token_sort("b a", "a b") == 100 and scorers.token_set("a b c", "a b") == 100
    assert scorers.partial("abc", "xxabcxx") == 100 and scorers.wratio("", "a") == 0
    assert round(scorers.jaro_winkler("MARTHA", "MARHTA"), 2) == 96.11
    assert scorers.get_scorer("nope") is scorers.wratio


def test_dedupe_and_compare(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, None, "z"), (3, "", "z")], "o int, k string, v string")
    assert [r.o for r in relational.dedupe(df, ["k"], ["o"]).orderBy("o").collect()] == [0, 2]
    pairs = spark.createDataFrame([("a", "a"), ("abcd", "abcx"), ("", ""), (None, "b")], "l string, r string")
    out = relational.compare(pairs, "l", "r", method="fuzzy", scorer="ratio", threshold=70, emit_score=True, review_threshold=90).collect()
    assert [(r.l_matches_r, r.l_matches_r_score, r.l_matches_r_review) for r in out] == [("true", 100, "false"), ("true", 75, "true"), ("false", 100, "false"), ("false", None, "false")]
    assert relational.compare(pairs, "l", "r", action="drop_matches").count() == 3
    assert relational.page_bounds(95, 9, 20) == (5, 80, 95)
    assert relational.toggled(None, "a") == relational.toggled(("b", True), "a") == relational.toggled(("a", False), "a") == ("a", True) and relational.toggled(("a", True), "a") == ("a", False)


def greedy(names, threshold, scorer):
    canonicals, known, out = [], {}, {}
    for name in names:
        key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.upper()).split())
        if key not in known:
            best = max(((scorer(key, c), -i, c) for i, c in enumerate(canonicals) if c[:4] == key[:4]), default=(-1, 0, None))
            if best[0] < threshold:
                canonicals.append(key)
            known[key] = best[2] if best[0] >= threshold else key
        out[name] = known[key]
    return out


def test_normalize_learn_is_sequential(spark):
    names = [f"{a} {b} {c}" for a in ("ACME", "ACMED", "BETA") for b in ("CORP", "CORPS", "WORKS") for c in ("ONE", "ONES", "TWO")]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    got = {r.name: r.canonical for r in match.normalize_learn(rows, 85, "ratio").collect()}
    assert got == greedy(names, 85, scorers.ratio)


def test_cascade_and_ledger(spark, xml):
    tables = xml_records.tables(xml_records.read_records(spark, str(xml)))
    seed = spark.createDataFrame([("Widget Incorporated", "w", 0), ("Gadget", "g", 1)], "organization string, id string, o long")
    entities, aliases = match.build_dictionary(match.build_reference(seed, "organization", "id", "o"))
    mentions = tables["assignors"].select("name").union(tables["assignees"].select("name")).withColumnRenamed("name", "mention")
    found = match.resolve_mentions(mentions, entities, aliases)
    got = {r.mention: (r.entity_id, r.resolution_source) for r in found.collect()}
    assert got["WIDGET INC"] == got["WIDGET, INC."] == ("w", "exact") and got["GADGET LLC"] == ("g", "exact")
    assert got["DOE, JANE"][1] == "person" and got["BANK OF X"][1] == "provisional"
    whole = {r.mention: r for r in found.collect()}
    assert all(r.ultimate_parent_id == r.entity_id for r in whole.values()) and whole["DOE, JANE"].canonical_name == "Doe Jane" and whole["BANK OF X"].entity_type == "company"
    made = ledger.build_ledger(tables["assignments"], tables["assignors"], tables["assignees"], tables["properties"], found)
    row = made["transaction_ledger"].collect()
    assert len(row) == 1 and row[0].buyer_entity_ids == ["g"] and row[0].property_count == 1 and row[0].transaction_date == "20240103"
    buyer = made["buyers"].first()
    assert (buyer.deals_count, buyer.patents_count, buyer.is_off_gazetteer) == (1, 1, False)
    bridge = ledger.reconcile_codes(made["buyer_property_bridge"], spark.createDataFrame([("10987654", "H04L 9/00")], "patent_id string, cpc string"))
    assert {r.cpc_lookup_status for r in bridge.collect()} == {"na", "found"}
    assert ledger.reconcile_codes(bridge, spark.createDataFrame([("10987654", "H04L 9/00")], "patent_id string, cpc string")).columns == bridge.columns


def test_reference_match(spark):
    reference = match.build_reference(spark.createDataFrame([("Acme Corp", "A1", 0), ("Beta Inc", "B1", 1)], "n string, i string, o long"), "n", "i", "o")
    df = spark.createDataFrame([("ACME CORP.; ZZZ",), ("beta ink",), (None,)], "assignor_names string")
    out = {r.assignor_names: r for r in match.reference_match(df, reference, "assignor_names", 80, "ratio", "; ", emit_score=True).collect()}
    assert out["ACME CORP.; ZZZ"].assignor_names_matched == "true" and out["ACME CORP.; ZZZ"].assignor_names_disambiguated == "Acme Corp; ZZZ"
    assert out["beta ink"].assignor_names_assignee_id == "B1" and out[None].assignor_names_matched is None
    assert match.reference_match(df, reference, "assignor_names", 80, "ratio", "; ", mode="all", action="keep").count() == 1


def test_codes(spark):
    df = spark.createDataFrame([("g", "10987654", "B2", "20240101", ["H04L 9/00", "G06F 1/00"]), ("h", "123", "B1", "20200101", ["A01B 1/00"])], "buyer string, doc_number string, doc_kind string, transaction_date string, cpc_codes array<string>")
    portfolio = codes.footprint(spark.createDataFrame([("9,000,001 B2", "H04L 1/00;G06F 3/00")], "patent string, cpc string"))
    out = codes.match_portfolio(portfolio, codes.buyer_patents(df, "buyer"))
    row = out["per"].collect()
    assert [(r.portfolio_patent, r.rank, r.buyer, r.overlap_strength, r.rank_score) for r in row] == [("9000001", 1, "g", 2.0, 27.0)]
    with pytest.raises(ValueError):
        codes.assert_hit_rate({"found": 1, "not_found": 9, "uncached": 0, "eligible": 10, "hit_rate": 0.1}, 0.5)


def _one_set(spark):
    """Twenty portfolio patents and forty buyers with one set of codes; buyer b0 has three patents, a null buyer two."""
    portfolio = spark.createDataFrame([(f"p{i}", c) for i in range(20) for c in ("A", "B")], "portfolio_patent string, code string")
    owned = [(f"b{i}", f"x{i}", ["A", "B"], 2001) for i in range(40)] + [("b0", "y", ["A", "B"], 0), ("b0", "z", ["C"], 2005), (None, "u", ["A", "B"], 2002), (None, "v", ["A", "B"], 2003)]
    return portfolio, spark.createDataFrame(owned, "buyer string, patent_id string, codes array<string>, year int")


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("least", [1, 2])
def test_class_rows_of_one_set(spark, uncoalesced, least):
    """A null buyer keeps its rows, as in SQL, and one set of codes is worked on by several tasks."""
    portfolio, patents = _one_set(spark)
    out = codes.match_portfolio(portfolio, patents, codes.MatchConfig(min_patents=least))["class"]
    many = {"b0": 2, None: 2}
    want = sorted(((f"p{i}", r.buyer, r.patent_id, c, str(r.year) if r.year else "", "false") for i in range(20) for r in patents.collect() if "A" in r.codes and many.get(r.buyer, 1) >= least for c in "AB"), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    if least == 1:
        assert out.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("metric", ["shared_count", "jaccard", "rarity_weighted"])
def test_ranks_of_one_set(spark, uncoalesced, metric):
    """Rows of one set of codes come from several tasks, with the same ranks for each portfolio patent."""
    portfolio, patents = _one_set(spark)
    out = codes.match_portfolio(portfolio, patents, codes.MatchConfig(metric=metric, threshold=0.5))["per"]
    rows = out.collect()
    assert out.columns == codes.PER and len(rows) == 20 * 41
    for i in range(20):
        mine = sorted((r for r in rows if r.portfolio_patent == f"p{i}"), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 42)) and [r.in_domain_patents for r in mine[:3]] == [2, 2, 1]
        assert {r.buyer: r.last_acquisition_date for r in mine} == {None: "2003"} | {f"b{i}": "2001" for i in range(40)}
    assert out.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("name, most", [("class", 1), ("per_jaccard", 1), ("per_rarity_weighted", 2), ("per_shared_count", 1)])
def test_match_reads_lines(spark, name, most):
    """The pairs of buyers and patents are made once; for weights twice, but from one shuffle."""
    plan = queries.queries()[f"cpc_match_{name}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == most
    assert len({re.sub(r"#\d+L?", "", x) for x in re.findall(r"Aggregate \[o_custkey[^\n]*", plan)}) == 1


@pytest.mark.parametrize("name", ["per", "class"])
def test_rows_of_one_set_keep_cores_busy(spark, name):
    """Few sums that make many rows are not merged into one task."""
    out = codes.match_portfolio(*_one_set(spark))[name]
    assert out.select(F.spark_partition_id()).distinct().count() > 4


@pytest.mark.parametrize("given", [False, True])
def test_weights_count_patents_without_codes(spark, given):
    portfolio, _ = _one_set(spark)
    patents = spark.createDataFrame([("b", "u", ["B", "A"], None), ("b", "v", ["A"], 2001), ("c", "w", [], 2002), (None, "x", None, 2003)], "buyer string, patent_id string, codes array<string>, year int")
    known = spark.createDataFrame([(["A", "B"],), (["A"],), (["Z"],), (["A", "Z"],)], "codes array<string>") if given else None
    out = codes.match_portfolio(portfolio, patents, codes.MatchConfig(metric="rarity_weighted"), known)["per"].collect()
    assert {(r.buyer, r.overlap_strength, r.in_domain_patents, tuple(r.shared_codes)) for r in out} == {("b", 8.0, 2, ("A", "B"))} and len(out) == 20


def test_service():
    answers = [(500, ""), (200, json.dumps({"patentFileWrapperDataBag": [{"applicationMetaData": {"patentNumber": "1", "cpcClassificationBag": ["H04L", "H04L"]}}]}))]
    service = code_api.CodeService("http://x", "k", lambda url, headers: answers.pop(0), sleep=lambda s: None)
    assert service.fetch(["1", "2"]) == {"1": ["H04L"]}
    answer = lambda status: code_api.CodeService("http://x", "k", lambda url, headers: (status, "{}"), sleep=lambda s: None).probe()
    assert answer(200) == answer(404) == "ok" and "403" in answer(403)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", ["a", None]), (2, None, [])], "n int, s string, l array<string>")
    for fmt in sinks.FORMATS:
        sinks.export(df, str(tmp_path / f"t.{fmt}"), fmt)
    assert json.loads((tmp_path / "t.json").read_text())[1] == {"n": 2, "s": None, "l": []}
    assert files.read_table_file(spark, str(tmp_path / "t.csv")).first().l == "a; "
    assert files.read_table_file(spark, str(tmp_path / "t.feather")).first().l == "a; "
    assert b"<row" in zipfile.ZipFile(tmp_path / "t.xlsx").read("xl/worksheets/sheet1.xml")
    assert sinks.unique_path(tmp_path / "t.csv").name == "t (1).csv"


def test_template(spark, xml, tmp_path):
    data = {
        "name": "t", "steps": [
            {"kind": "filter", "table": "flat", "clauses": [{"column": "conveyance_text", "op": "contains", "value": "assignors interest"}]},
            {"kind": "classify", "table": "flat", "column": "assignor_names"},
            {"kind": "normalize", "table": "flat", "column": "assignor_names", "emit_score": True, "scorer": "token_set"},
            {"kind": "derive", "table": "flat", "source": "transaction_date"},
            {"kind": "dedupe", "table": "flat", "subset": ["reel_no"]},
            {"kind": "aggregate", "table": "flat", "group_by": ["transaction_date_year"]},
            {"kind": "export", "fmt": "csv", "tables": ["flat", "flat_by_transaction_date_year"]},
        ],
    }
    (plan,) = template.load_templates(json.dumps(data))
    assert template.validate(plan) == [] and template.encode(template.decode(template.encode(plan))) == template.encode(plan)
    manifest = batch.run(spark, plan, [str(xml)], str(tmp_path / "out"))
    assert manifest["inputs"][0]["error"] is None and len(manifest["inputs"][0]["files"]) == 2
    out = files.read_table_file(spark, manifest["inputs"][0]["files"][0])
    assert out.columns == template.columns_after(plan)["flat"]
    row = out.collect()
    assert len(row) == 1 and row[0].assignor_names_type == "company" and row[0].transaction_date_year == "2024"
    assert batch.preview(spark, plan, str(xml), 1)[0]["flat"].count() == 1
    for bad in ({"kind": "nope"}, {"kind": "sort"}, {"kind": "filter", "table": "t", "clauses": [{"op": "like"}]}, {"kind": "dedupe", "table": "t", "enabled": 1}):
        with pytest.raises(ValueError):
            template.decode_step(bad)
    odd = template.decode({"name": "x", "steps": [{"kind": "sort", "table": "flat", "column": "zz"}, {"kind": "export", "tables": ["q"]}]})
    assert len(template.validate(odd)) == 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_cluster_components_all(spark, tmp_path):
    edges = [(o, p, s) for o, (p, s) in enumerate([(1, 1), (98, 2), (195, 2), (3, 1), (3, 4), (500, 9), (597, 8), (6, 8), (7, 7)])]
    spark.createDataFrame(edges, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    least = {k: k for _, p, s in edges for k in (f"p{p}", f"q{s}")}
    for _ in least:
        for _, p, s in edges:
            least[f"p{p}"] = least[f"q{s}"] = min(least[f"p{p}"], least[f"q{s}"])
    got = {r.node: r.root for r in queries.queries()["cluster_components_all"](spark, str(tmp_path)).collect()}
    assert got == least and len(set(least.values())) == 5


def test_rules_of_documents_and_conveyances(spark):
    df = spark.createDataFrame([("1234567", "A1"), ("12345678", "A2"), ("20200012345", "A2"), ("1234567", "A"), ("20200012345", "A")], "n string, k string")
    assert [r[0] for r in df.select(text.doc_type(df.n, df.k)).collect()] == ["unknown", "unknown", "publication", "grant", "publication"]
    df = spark.createDataFrame([("CHANGE OF NAME AND MERGERS",), ("NAME CHANGE",), ("licence",), (None,)], "t string")
    assert [r[0] for r in df.select(text.conveyance_type(df.t)).collect()] == ["merger", "name_change", "license", None]
    assert [r[0] for r in spark.createDataFrame([("DOE JANE 3RD",), ("A1B C",), ("",)], "k string").select(text.title_key("k")).collect()] == ["Doe Jane 3Rd", "A1B C", ""]
    assert scorers.partial("c bcc  a", " b  bcca") == scorers.partial(" b  bcca", "c bcc  a")


def test_learning(spark, tmp_path):
    memory = Memory()
    memory.add("Acme Widgets")
    memory.set_alias("ACMEE WIDGETS", "Acme Widgets")
    memory.learn([("ACME WIDGET", "Acme Widgets", 93)])
    values = spark.createDataFrame([("Acme Widgets!", 0), ("acmee widgets", 1), ("Acme widget", 2), ("Zeta Forge", 3), ("--", 4)], "name string, ord long")
    found = {r.name: (r.canonical, r.score, r.learned) for r in match.normalize_learn(values, 95, "ratio", memory.table(spark), learn=False).collect()}
    assert found == {"Acme Widgets!": ("Acme Widgets", 100, True), "acmee widgets": ("Acme Widgets", 100, False), "Acme widget": ("Acme Widgets", 93, False), "Zeta Forge": ("ZETA FORGE", 0, False), "--": ("--", 0, False)}
    found = {r.name: (r.canonical, r.score, r.learned) for r in match.normalize_learn(values, 95, "ratio", memory.table(spark)).collect()}
    assert found["Zeta Forge"] == ("ZETA FORGE", 100, True)
    names = [f"SAME {c}{d}" for c in "ABCDEFGH" for d in "XYZ"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")
    assert {r.canonical for r in match.normalize_learn(rows, 100, "ratio", cap=3).collect()} == set(names)

    assert memory.review(95) == [("ACME WIDGET", "Acme Widgets", 93)] and memory.review(95, "zzz") == []
    memory.rename("Acme Widgets", "Acme")
    memory.set_type("Acme", "company")
    memory.add("Akme")
    memory.fold("Akme", "Acme")
    assert memory.aliases["ACME WIDGET"] == ("Acme", 93) and memory.aliases["AKME"] == ("Acme", 100)
    memory.save(str(tmp_path / "m.json"))
    again = Memory.load(str(tmp_path / "m.json"))
    assert again == memory and Memory.load(str(tmp_path / "none.json")) == Memory()
    assert Memory.from_dict({"canonicals": ["B"], "aliases": {"b b": "B"}}).aliases == {"b b": ("B", 100)}
    other = Memory.from_dict({"canonicals": ["Acme", "Beta"], "aliases": {"AKME": ["Beta", 91]}, "types": {"Acme": "unknown"}})
    again.merge(other)
    assert list(again.canonicals) == ["Acme", "Beta"] and again.aliases["AKME"] == ("Beta", 91) and again.types["Acme"] == "company"
    again.confirm("AKME")
    assert again.review() == [("ACME WIDGET", "Acme", 93)]
    again.delete("Beta")
    assert "AKME" not in again.aliases and again.tag(spark, only_missing=True) == 0
    (tmp_path / "s.csv").write_text("Gama,Gamma\nDelta\n")
    (tmp_path / "s.txt").write_text("Eps\n\n")
    (tmp_path / "s.json").write_text('["Eta"]')
    for suffix, count in (("csv", 3), ("txt", 4), ("json", 5)):
        assert again.seed(str(tmp_path / f"s.{suffix}")) == count
    assert again.aliases["GAMA"] == ("Gamma", 100)

    df = spark.createDataFrame([(0, "Zeta Forge; Acme widget"), (1, None), (2, " ; ")], f"{relational.ORDINAL} long, x_names string")
    learned = []
    out = match.normalize_column(df, "x_names", relational.ORDINAL, separator="; ", threshold=95, scorer="ratio", emit_score=True, emit_type=True, learn=False, known=memory.table(spark), types=memory.type_table(spark), learned=learned)
    got = {r[0]: (r.x_names_canonical, r.x_names_canonical_score, r.x_names_canonical_type) for r in out.collect()}
    assert got == {0: ("ZETA FORGE; Acme", 0, "company"), 1: (None, None, None), 2: ("", 100, "")} and learned[0].count() == 0


def test_tolerant_xml(spark, xml, tmp_path):
    good = RECORD.format(7, "ASSIGNMENT", PERSON.format("A&nbsp;B & C &eacute;&zzz;", "20240101"), "D LLC").replace("<patent-assignment>", "<patent-assignment\n>")
    path = tmp_path / "odd.xml"
    path.write_text(f"<root>{good}\n<patent-assignment><x></patent-assignment></root>")
    records = xml_records.read_records(spark, str(path)).collect()
    assert len(records) == 1 and records[0].assignors[0]["name"] == "A\xa0B & C é"
    assert xml_records.lost_records(spark, str(path)) == 1


def test_runs(spark, xml, tmp_path):
    plan = template.decode({"name": "a/b", "steps": [
        {"kind": "normalize", "table": "flat", "column": "assignee_names", "target": "name_canonical"},
        {"kind": "filter", "table": "flat", "clauses": [{"column": "reel_no", "op": "equals", "value": "none"}]},
        {"kind": "export", "fmt": "csv", "tables": ["flat", "gone"], "columns": {"flat": ["reel_no", "zz"]}, "renames": {"flat": {"reel_no": "reel"}}},
    ]})
    memory, heard = Memory(), []
    record = batch.run(spark, plan, [str(xml), str(tmp_path / "none.xml")], str(tmp_path / "out"), memory=memory, events=lambda *e: heard.append(e), trace="csv", timestamp="t")
    assert record["summary"] == {"succeeded": 1, "failed": 1} and "GADGET LLC" in memory.canonicals
    assert any(level == "error" and "without rows" in m for level, m in heard) and any("no table gone" in m for _, m in heard)
    steps = record["results"][0]["steps"]
    assert steps[0]["columns_added"] == ["assignee_names_canonical"] and (steps[1]["rows_before"], steps[1]["rows_after"], steps[1]["note"]) == (4, 0, "dropped all rows")
    home = tmp_path / "out" / "a_b_t"
    assert {p.name for p in home.iterdir()} == {"in", "manifest.json", "run.log", "summary.xlsx"}
    assert (home / "in" / "flat.csv").read_text().strip() == "reel" and sorted(p.name for p in (home / "in" / "steps").iterdir()) == ["01_flat.csv", "02_flat.csv"]
    assert len((tmp_path / "out" / "runs_index.csv").read_text().splitlines()) == 2
    whole = template.decode({"name": "c", "steps": [{"kind": "export", "fmt": "parquet", "tables": ["assignors"]}]})
    for _ in range(2):
        batch.run(spark, whole, [str(xml)], str(tmp_path / "conv"), convert=True, existing="skip")
    assert sorted(p.name for p in (tmp_path / "conv").iterdir()) == ["_convert_index.csv", "in.parquet"]
    batch.run(spark, whole, [str(xml)], str(tmp_path / "conv"), convert=True, existing="unique")
    assert (tmp_path / "conv" / "in (1).parquet").exists()
    assert template.needed_tables(whole) == {"assignors"} and files.inputs_columns(spark, [str(tmp_path / "conv" / "in.parquet"), str(xml)]) == {"flat": COLUMNS["assignors"]}
    assert batch.run(spark, whole, [str(xml)], str(tmp_path / "stop"), should_stop=lambda: True)["cancelled"]
    with pytest.raises(ValueError):
        batch.run(spark, plan, [str(xml)], str(tmp_path / "strict"), strict=True)


def test_code_steps(spark, xml, tmp_path):
    (tmp_path / "codes.csv").write_text("Publication Number,CPC\nUS10987654B2,H04L 9/00;G06F 1/00\n")
    (tmp_path / "portfolio.csv").write_text("patent,cpc\n9000001,H04L 1/00\n")
    (tmp_path / "list.txt").write_text("US 9,000,001 B2\n\n")
    steps = [
        {"kind": "normalize", "table": "flat", "column": "assignee_names"},
        {"kind": "attach_cpc_file", "source_path": str(tmp_path / "codes.csv")},
        {"kind": "cpc_match", "portfolio_mode": "footprint_file", "portfolio_path": str(tmp_path / "portfolio.csv"), "emit_class_matches": True},
    ]
    plan = template.decode({"name": "c", "steps": steps})
    settings = config.Context(config.Config.from_dict({"match": {"hit_rate_floor": 0.4}}))
    tables = template.compile_template(spark, plan, files.load(spark, str(xml)), settings)
    assert {r.buyer for r in tables["matched_buyers_by_portfolio_patent"].collect()} == {"BANK OF X", "GADGET LLC"}
    assert tables["matched_buyers_by_portfolio_patent"].columns == codes.PER and tables["matched_buyers_overall"].columns == codes.OVERALL and tables["matched_cpc_classes"].columns == codes.CLASSES
    assert template.columns_after(plan)["matched_cpc_classes"] == codes.CLASSES

    asked = []

    def transport(url, headers):
        asked.append(url)
        return 200, json.dumps({"patentFileWrapperDataBag": [{"m": {"n": n, "c": ["H04L 9/00"]}} for n in ("10987654", "9000001") if n in url]})

    source = {"type": "api", "endpoint": "http://x", "api_key_env": "PATH", "patent_query_field": "m.n", "cpc_response_field": "m.c"}
    settings = config.Context(config.Config.from_dict({"source": source, "cache": {"path": str(tmp_path / "cache")}}), True, transport)
    plan = template.decode({"name": "c", "steps": [steps[0], {"kind": "fetch_cpc"}, {"kind": "cpc_match", "portfolio_path": str(tmp_path / "list.txt")}]})
    for _ in range(2):  # the second time from the cache
        tables = template.compile_template(spark, plan, files.load(spark, str(xml)), settings)
        assert tables["matched_buyers_by_portfolio_patent"].count() == 2 and len(asked) == 2
    offline = template.apply_step(spark, files.load(spark, str(xml)), plan.steps[1])["flat"]
    assert {r[0] for r in offline.select("cpc_lookup_status").distinct().collect()} == {"na", "uncached"}
    settings.config.save(str(tmp_path / "c.json"))
    assert config.Config.load(str(tmp_path / "c.json")) == settings.config
    query = config.Query("q", clauses=[filters.Clause("a", "equals", "b")], sort=("a", False))
    config.dump_queries([query], str(tmp_path / "q.json"))
    assert config.load_queries(str(tmp_path / "q.json")) == [query]
    stores = config.Stores(str(tmp_path / "stores"))
    stores.move_memory("/elsewhere.json")
    assert stores.memory_path() == "/elsewhere.json" and stores.recent("b") == ["b"] and stores.recent("a") == ["a", "b"]


def test_command_line(spark, xml, tmp_path, capsys):
    from titleforge import cli

    def run(*arguments):
        assert cli.main([str(a) for a in arguments], spark) == 0
        return capsys.readouterr().out

    assert json.loads(run(xml, "--outdir", tmp_path / "p"))["flat"] == 4 and (tmp_path / "p" / "assignments.xlsx").exists()
    run("ingest", xml, "--out", tmp_path / "raw")
    (tmp_path / "g.csv").write_text("organization,assignee_id\nWidget Incorporated,w\nGadget,g\n")
    assert "2 organizations" in run("build-reference", tmp_path / "g.csv", "--out", tmp_path / "g.parquet")
    assert json.loads(run("build-dictionary", "--out", tmp_path / "d", "--reference", tmp_path / "g.csv")) == {"entities": 2, "aliases": 3}
    first = json.loads(run("resolve", "--raw", tmp_path / "raw", "--dict", tmp_path / "d", "--out", tmp_path / "m"))
    again = json.loads(run("resolve", "--raw", tmp_path / "raw", "--dict", tmp_path / "d", "--out", tmp_path / "m"))
    assert first == {"exact": 3, "person": 1, "provisional": 1} and again == {"exact": 4, "person": 1}
    metrics = json.loads(run("ledger", "--raw", tmp_path / "raw", "--dict", tmp_path / "d", "--out", tmp_path / "l"))
    assert metrics["transactions_firm_to_firm"] == 1 and metrics["bridge_grant_rows"] == 1
    (tmp_path / "c.csv").write_text("patent_id,cpc_group\n10987654,H04L 9/00\n")
    out = run("report", "--ledger", tmp_path / "l", "--cpc-file", tmp_path / "c.csv", "--cpc-mode", "sampled")
    assert '"cpc_hit_rate": 1.0' in out and "\tGadget\t" in out
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.json").write_text(json.dumps({"name": "n", "steps": [{"kind": "sort", "table": "flat", "column": "zz"}]}))
    run("templates-summary", "--templates", tmp_path / "t")
    assert "no column zz" in (tmp_path / "t" / "TEMPLATES.md").read_text()
    assert json.loads(run("run", tmp_path / "t" / "one.json", xml, "--out", tmp_path / "r"))["succeeded"] == 1


def test_bundled_steps_and_references(spark, xml, tmp_path):
    """A reference step with its own targets, kept and dropped rows, and a table of a store, over one input."""
    (tmp_path / "g.tsv").write_text("assignee_id\tdisambig_assignee_organization\nw\tWidget Inc\n")
    step = {"kind": "reference_match", "table": "flat", "column": "assignor_names", "reference_path": str(tmp_path / "g.tsv"), "target": "org", "emit_score": True}
    tables = files.load(spark, str(xml))
    plan = template.decode({"name": "r", "steps": [step, {"kind": "kind_filter", "types": ["grant"]}]})
    flat = template.compile_template(spark, plan, tables)["flat"]
    assert template.columns_after(plan)["flat"] == [c for c in flat.columns if c != relational.ORDINAL]
    got = {r.reel_no: (r.org, r.assignor_names_matched) for r in flat.collect()}
    assert got == {"1": ("Widget Inc; Widget Inc", "true"), "2": ("DOE, JANE", "false")}
    for action, reels in (("keep_matched", {"1"}), ("drop_matched", {"2"})):
        plan = template.decode({"name": "r", "steps": [step | {"action": action}]})
        assert {r.reel_no for r in template.compile_template(spark, plan, tables)["flat"].collect()} == reels
    assert match.load_reference(spark, str(tmp_path / "g.tsv"), "disambig_assignee_organization") is match.load_reference(spark, str(tmp_path / "g.tsv"), "disambig_assignee_organization")
    assert sinks.scoped_path(tmp_path / "a.csv", "filtered").name == "a_filtered.csv"
    for bad in ({"kind": "kind_filter", "types": ["odd"]}, {"kind": "dedupe", "table": "t", "subset": "x"}, {"kind": "transfer_type", "assignor_type": "firm"}, {"kind": "filter", "table": "t", "clauses": {}}):
        with pytest.raises(ValueError):
            template.decode_step(bad)


def test_name_model(spark, tmp_path):
    df = spark.createDataFrame([("Zorbo Quant",), ("Mary Major",), ("Widget Inc",), ("Doe, Jane",), ("Zorbo",), ("",)], "n string")
    model = classify.NameModel({" ZOR": 4.0, " MAR": -4.0}, (0.0, 0.0, 0.0, 0.5, 0.0), -0.5)
    model.save(str(tmp_path / "m.json"))
    assert classify.NameModel.load(str(tmp_path / "m.json")) == model and classify.NameModel.load(str(tmp_path / "none.json")) is None
    got = [r[0] for r in df.select(classify.classify(df.n, "model", model)).collect()]
    assert got == ["company", "individual", "company", "individual", "unknown", "unknown"]
    flags = df.select(*[f.alias(f"f{i}") for i, f in enumerate(classify.token_flags(df.n))]).collect()
    assert tuple(flags[2]) == (True, False, False, True, False) and tuple(flags[3])[1]
    with pytest.warns(UserWarning):
        assert [r[0] for r in df.select(classify.classify(df.n, "probablepeople")).collect()][0] == "individual"
