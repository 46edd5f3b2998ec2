from datetime import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import markdown as M
from tessella.functions import names as N
from tessella.functions import scalars as S
from tessella.operators import criteria as C
from tessella.operators import doc_rules as D
from tessella.operators import edges as E
from tessella.operators import report as R
from tessella.operators import rules as P
from tessella.operators import tokens as K
from tessella.plans.layers import CATALOG, RULESET, merged
from tessella.sources import files, php
from tessella.streaming import events
from tests import fixtures as X

A, B = "App\\Common\\Module\\One\\", "App\\Common\\Module\\Two\\"
#: (depender, dependent, type, crosses modules, breaks a service contract)
EDGES = [
    (A + "Domain\\Service\\X", B + "Domain\\Service\\YInterface", "PARAMETER", 1, 1),
    (A + "Domain\\Service\\X", B + "Domain\\Entity\\Y", "PARAMETER", 1, 0),
    (A + "Infrastructure\\X", B + "Application\\Service\\Y", "PARAMETER", 1, 1),
    (A + "Integration\\X", B + "Application\\Service\\Y", "PARAMETER", 0, 1),
    (A + "Integration\\X", B + "Application\\UseCase\\Query\\Y\\YQueryHandler", "PARAMETER", 0, 0),
    (A + "Integration\\X", B + "Infrastructure\\Service\\Y", "PARAMETER", 1, 1),
    (A + "Domain\\Entity\\X", B + "Domain\\Entity\\Y", "INHERIT", 0, 0),
    (A + "Application\\UseCase\\Command\\X\\XCommandHandler", B + "Domain\\Repository\\Y", "PARAMETER", 0, 0),
    (A + "Application\\UseCase\\Query\\X\\XQueryHandler", B + "Domain\\Entity\\Y", "PARAMETER", 1, 0),
    (A + "Infrastructure\\X", B + "Domain\\ValueObject\\Y", "PARAMETER", 0, 0),
    (A + "Infrastructure\\X", B + "Domain\\Enum\\Y", "PARAMETER", 0, 0),
    (A + "Infrastructure\\X", B + "Domain\\Any\\YDto", "PARAMETER", 0, 0),
    (A + "Infrastructure\\X", B + "Domain\\Service\\YInterface", "USE", 0, 0),
    ("App\\Web\\X", B + "Domain\\Service\\YInterface", "INHERIT", 0, 1),
    ("App\\Web\\X", B + "Domain\\Entity\\Y", "PARAMETER", 0, 0),
    (A + "Integration\\X", A + "Application\\Service\\YInterface", "PARAMETER", 0, 1),
    (A + "Integration\\X", A + "Application\\Service\\Y", "PARAMETER", 0, 0),
    (A + "Integration\\X", A + "Domain\\Service\\YInterface", "INHERIT", 0, 0),
    (A + "Domain\\X", A + "Application\\Service\\YInterface", "INHERIT", 0, 1),
    ("Common\\Module\\One\\Domain\\Service\\X", "Common\\Module\\Two\\Domain\\Service\\YInterface", "PARAMETER", 1, 1),
    ("App2\\Common\\Module\\One\\Domain\\X", B + "Domain\\Service\\Y", "PARAMETER", 0, 1),
    (None, B + "Domain\\Service\\Y", "PARAMETER", 0, 1),
    (A + "Domain\\X", None, "PARAMETER", 0, 0),
    (A + "Domain\\X", B + "Domain\\Service\\Y", None, 1, 1),
]


def test_edge_rules(spark):
    df = spark.createDataFrame([(i, *e[:3]) for i, e in enumerate(EDGES)], "i int, depender string, dependent string, dep_type string")
    triple = [F.col(c) for c in ("depender", "dependent", "dep_type")]
    got = {r.i: (int(r.a), int(r.b)) for r in df.select("i", E.cross_module(*triple).alias("a"), E.service_contract(*triple).alias("b")).collect()}
    assert got == {i: e[3:] for i, e in enumerate(EDGES)}
    for k, rule in ((3, "CrossModule"), (4, "ServiceContract")):
        broken = E.violating(df, rule)
        assert broken.columns == df.columns and sorted(r.i for r in broken.collect()) == [i for i, e in enumerate(EDGES) if e[k]]
        assert sorted(r.i for r in E.edge_violations(df, [rule]).collect()) == [i for i, e in enumerate(EDGES) if e[k]]
    # A name is matched once, whatever is asked of its parts.
    assert E.violating(df, "CrossModule")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


def test_registered_edge_rules(spark):
    E.register_edge_rule("Self", lambda a, b, kind: a == b, lambda b: F.lit("none"))
    try:
        df = spark.createDataFrame([("X", "X", "USE"), ("X", "Y", "USE")], "depender string, dependent string, dep_type string")
        assert [tuple(r) for r in E.edge_violations(df).collect()] == [("X", "X", "USE", "Self", "none")]
        assert E.violating(df, "Self").count() == 1
        with pytest.raises(ValueError):
            E.register_edge_rule("Self", E.cross_module, lambda b: b)
    finally:
        E.EDGE_RULES.pop("Self")


def test_violation_names_first_layer(spark):
    df = spark.createDataFrame([(A + "Domain\\X", B + "Domain\\Service\\Y", "PARAMETER", ["L1", "L2"]), (A + "Domain\\X", B + "Domain\\Service\\Y", "PARAMETER", [])], "depender string, dependent string, dep_type string, dependent_layers array<string>")
    assert sorted((r.rule, r.layer) for r in E.edge_violations(df).collect()) == [("CrossModule", "L1"), ("CrossModule", "Unknown"), ("ServiceContract", "Domain"), ("ServiceContract", "L1")]


def test_layers(spark):
    cases = {
        "Common\\Module\\M\\Domain\\Entity\\X": {"Domain"},
        "Common\\Module\\M\\Domain\\Entity\\ValueObject\\XVo": {"DomainVo"},
        "Common\\Module\\M\\Infrastructure\\Component\\Pdf\\Page": set(),
        "Common\\Module\\M\\Infrastructure\\Listener\\X": set(),
        "Common\\Module\\M\\Infrastructure\\Component\\Pdf\\PdfComponent": {"InfrastructureComponent"},
        "Common\\Module\\M\\Application\\UseCase\\Command\\Pay\\PayCommand": {"ApplicationCommand"},
        "Common\\Module\\M\\Application\\UseCase\\Command\\Pay\\PayCommandHandler": {"ApplicationCommandHandler"},
        "Web\\Module\\M\\X": {"Presentation"},
        "Common\\Application\\Dto\\XDto": {"ApplicationCommonDto"},
    }
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: set(r.x) for r in df.select("name", E.layers_of(F.col("name")).alias("x")).collect()} == cases
    assert len(CATALOG) == 20 and len(RULESET) == 19 and sum(map(len, RULESET.values())) == 86


def test_closure_expands_plus(spark):
    rows = {(r.layer, r.target) for r in E.allowed_layers(spark).collect()}
    assert ("Application", "ApplicationDto") in rows and ("Application", "ApplicationCommand") in rows and ("DomainVo", "DomainDto") not in rows


def test_closure_of_a_cycle(spark):
    got = {(r.layer, r.target) for r in E.allowed_layers(spark, {"a": ["+b", "x"], "b": ["+c"], "c": ["+a", "y"], "d": ["+a"], "e": ["a"]}).collect()}
    every = {"a", "b", "c", "x", "y"}
    assert got == {(layer, t) for layer in "abcd" for t in every} | {("e", "a")}


def test_merged_configuration():
    assert merged({"a": [1], "b": {"c": 1}}, {"a": [1, 2], "b": {"d": 2}, "e": 3}) == {"a": [1, 2], "b": {"c": 1, "d": 2}, "e": 3}


def test_tokens_join_to_source():
    for path, (source, _) in X.SOURCES.items():
        assert "".join(t["content"] for t in php.tokenize(source)) == source, path


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab{}()[]'\"$;#/*\\\n <>?:-=", max_size=60))
def test_any_text_is_tokenized(text):
    assert "".join(t["content"] for t in php.tokenize("<?php " + text)) == "<?php " + text


def test_rules_over_empty_and_null_sources(spark):
    t = php.tokens(spark.createDataFrame([("a.php", None), ("b.php", ""), ("c.php", "text")], "path string, content string"))
    assert [r.code for r in t.collect()] == ["T_INLINE_HTML"]
    assert P.violations(t).count() == 0


def test_token_rows_give_what_units_give(spark):
    sources = spark.createDataFrame([(p, c) for p, (c, _) in X.SOURCES.items()], "path string, content string")
    want = sorted((p, line, rule, code) for p, (_, found) in X.SOURCES.items() for line, rule, code in found)
    rows = php.tokens(sources)
    for source in (php.units(sources), rows):
        assert sorted((r.path, r.line, r.rule, r.code) for r in P.violations(source).collect()) == want
    plan = P.violations(php.units(sources))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_token_joins(spark):
    sources = spark.createDataFrame([(p, X.SOURCES[p][0]) for p in ("lib/Kind.php", "lib/WrongDto.php", "lib/calls.php")], "path string, content string")
    rows = php.tokens(sources).persist()
    owners = rows.filter("code IN ('T_ENUM', 'T_CLASS')")
    kids = K.direct_children(owners, rows).filter("code IN ('T_FUNCTION', 'T_ENUM_CASE')").collect()
    assert sorted((r.owner_name, r.code, r.line) for r in kids) == [("Kind", "T_ENUM_CASE", 6), ("Kind", "T_ENUM_CASE", 7), ("Kind", "T_FUNCTION", 8), ("WrongDto", "T_FUNCTION", 9), ("WrongDto", "T_FUNCTION", 15)]
    inside = K.within_scope(owners, rows).filter("code = 'T_FUNCTION'")
    assert inside.count() == 4  # the method of the class within, too
    after = rows.withColumn("next", K.next_of(("T_STRING",), F.col("content"))).filter("code = 'T_ENUM_CASE'")
    assert sorted(r.next for r in after.collect()) == ["Upper", "goodName"]
    calls = K.neighbours(rows).filter("code = 'T_NAME_FULLY_QUALIFIED' AND next_code = 'T_OPEN_PARENTHESIS'")
    assert {(r.content, r.previous_code) for r in calls.collect()} >= {("\\Date", "T_NEW"), ("\\is_null", "T_RETURN")}
    rows.unpersist()


def test_rule_registration(spark):
    P.register_rule("None", lambda tokens, path: P._none())
    try:
        with pytest.raises(ValueError):
            P.register_rule("None", P.global_calls)
    finally:
        P.RULES.pop("None")


def test_rules_of_a_directory(spark, tmp_path):
    (tmp_path / "a.py").write_text("from pyspark.sql import functions as F\nfrom tessella.operators import rules as P\nRULES = {'Own': lambda tokens, path: F.transform(F.slice(tokens, 1, 1), lambda t: P._at(t, 'First', 'the first token'))}\n")
    (tmp_path / "_b.py").write_text("1 / 0")
    assert P.register_directory(str(tmp_path)) == ["Own"]
    try:
        files_ = spark.createDataFrame([("a.php", "<?php\n")], "path string, content string")
        assert [(r.rule, r.message) for r in P.violations(php.units(files_)).collect()] == [("Own", "the first token")]
    finally:
        P.RULES.pop("Own")


def test_message_map(spark):
    t = php.tokens(spark.createDataFrame([("lib/calls.php", X.SOURCES["lib/calls.php"][0])], "path string, content string"))
    (row,) = R.message_map(P.violations(t, ["GlobalCalls"])).collect()
    assert sorted(row.messages) == [2, 3, 5, 6] and [m.fixable for m in row.messages[5]] == [True, True]


def test_report_and_plan(spark):
    e = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "path string, line int, n int")
    a = spark.createDataFrame([("a", 2, 3), ("a", 4, 1)], "path string, line int, n int")
    assert sorted(map(tuple, R.differences(e, a, "path").collect())) == [("a", 1, 1, 0), ("a", 2, 1, 3), ("a", 4, 0, 1)]
    assert R.verdict(e).collect()[0].exit_code == 1 and R.verdict(e.limit(0)).collect()[0].exit_code == 0
    assert R.with_entry("a\n", "b") == "a\nb\n" and R.with_entry("a\nb", "b") == "a\nb"


def test_front_matter(spark):
    rows = [(1, "---\nk: 'v'\nk: \"w\"\nu: http://x\n#c: d\n---\nbody"), (2, "---\n---\n"), (3, "x"), (4, None)]
    df = spark.createDataFrame(rows, "i int, c string")
    got = {r.i: (r.f, r.b) for r in df.select("i", M.front_matter(F.col("c")).alias("f"), M.body(F.col("c")).alias("b")).collect()}
    assert got == {1: ({"k": "w", "u": "http://x"}, "body"), 2: (None, "---\n---\n"), 3: (None, "x"), 4: (None, None)}


def test_paths(spark):
    rows = [("/usr/src/app/src/Module/X.php", "src/app/src/Module/X.php"), ("lib/X.php", None), ("src/a", "src/a")]
    df = spark.createDataFrame(rows, "p string, e string")
    assert all(r.g == r.e for r in df.select("e", N.below_src(F.col("p")).alias("g")).collect())
    fold = {"a/../../b": "b", "/a/./b//c/..": "/a/b", "../x": "x"}
    df = spark.createDataFrame([(k,) for k in fold], "p string")
    assert {r.p: r.f for r in df.select("p", N.fold_path(F.col("p")).alias("f")).collect()} == fold


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).head().x
    assert get(S.discounted(F.lit("100.123456").cast("decimal(18,6)"), F.lit("percent"), F.lit("12.345678").cast("decimal(18,6)"))) == Decimal("12.360919")
    assert get(S.discounted(F.lit(10), F.lit("percent"), F.lit(200))) == 10 and get(S.discounted(F.lit(10), F.lit("fixed"), F.lit(-1))) == 0
    assert get(S.truncated(F.lit("0.12345678").cast("decimal(18,8)"), 6)) == Decimal("0.123456")
    assert [get(S.size_text_loop(F.lit(n))) for n in (0, 1024, 1025, 1 << 20)] == ["0 B", "1024 B", "1 KB", "1024 KB"]
    assert [get(S.size_text_log(F.lit(n))) for n in (0, 1023, 1024, 1 << 20)] == ["0 B", "1023 B", "1 KB", "1 MB"]
    assert get(S.email(F.lit(" A@B.co "))) == "a@b.co" and get(S.email(F.lit("a@b"))) is None
    assert get(S.fixed10(F.lit(1.5))) == "1.5000000000"
    assert get(N.strip_extension(F.lit("a.tar.gz"))) == "a.tar"
    with pytest.raises(Exception, match="unequal"):
        get(S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def test_criteria_errors(spark):
    df = spark.createDataFrame([(1, "u1", "x"), (2, "u2", None)], "id int, uuid string, v string")
    with pytest.raises(C.NoKey):
        C.get_by_id(df)
    with pytest.raises(Exception, match="not found: id=9"):
        C.get_by_id(df, 9).collect()
    with pytest.raises(Exception, match="not found: uuid=u9"):
        C.get_by_id(df, None, "u9").collect()
    assert C.matching(df, object(), foreign="all").count() == 2
    with pytest.raises(Exception, match="there twice: 2"):
        C.merged_strict(df, df.filter("id = 2"), "id").collect()
    assert [r.value for r in C.listed(spark, ["b", "a"]).collect()] == ["b", "a"]
    assert C.get_by_id(df, 1, "u2").head().uuid == "u1" and C.get_by_id(df, None, "u2").head().id == 2
    with pytest.raises(TypeError):
        C.matching(df, object())
    with pytest.raises(ValueError):
        C.find(df, C.Criteria(sort=("v",)), allowed=("id",))
    with pytest.raises(Exception, match="no text for"):
        C.translated(df, "id", {1: "a"}).collect()
    assert df.select(C.given(a=F.col("id"), b=F.col("v")).alias("m")).filter("id = 2").head().m == {"a": "2"}
    assert (C.Specification(F.col("v") == "x") | ~C.Specification(F.col("id") == 2)).of(df).count() == 1
    assert C.one_or_none(df, C.Criteria(equal={"id": 3})).count() == 0


def test_batches_and_fix(spark, tmp_path):
    df = spark.range(10).toDF("id")
    ids = lambda b: sorted(r.id for r in b.collect())
    assert [(k, ids(b)) for k, b in C.batches(df, "id", 4)] == [(3, [0, 1, 2, 3]), (7, [4, 5, 6, 7]), (9, [8, 9])]
    odd = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (3,)], "id long")
    assert [(k, b.count()) for k, b in C.batches(odd, "id", 2)] == [(1, 3), (3, 2), (None, 1)]
    assert [k for k, _ in C.batches(odd, "id", 2, 2)] == [3, None] and list(C.batches(df.limit(0), "id", 2)) == []
    big = spark.range(2500).toDF("id").withColumn("state", F.lit("old"))
    done, kept = [], []
    where, change, root = F.col("id") >= 100, {"state": F.lit("new")}, str(tmp_path)

    def write(rows, number):
        if number == 1 and len(done) == 1:
            done.append("broken")
            raise OSError("connection lost")
        done.append((number, rows.filter("state = 'new'").count(), rows.agg(F.min("id")).head()[0]))

    args = (big, where, change, True, lambda hit: kept.append(C.backup(hit, root, "StateFix", "orders", ("id",), datetime(2024, 5, 6, 7, 8, 9))), write, "id", 1000, str(tmp_path / "progress"))
    with pytest.raises(OSError):
        C.data_fix(*args)
    assert tuple(C.data_fix(*args).head()) == (2400, 2400)
    assert done == [(0, 1000, 100), "broken", (1, 1000, 1100), (2, 400, 2100)]
    assert kept == [f"{root}/StateFix/orders-20240506-070809.csv"] and spark.read.option("header", True).csv(kept[0]).count() == 2400
    assert tuple(C.data_fix(big, where, change, False).head()) == (2400, 2400) and len(done) == 4
    with pytest.raises(ValueError):
        C.data_fix(big, where, change, False, size=10)


def test_batches_are_numbered_at_once(spark, tmp_path, monkeypatch):
    from tessella import catalog
    from tests.oracle import both

    keys = [*range(1000), *[500] * 90, *[None] * 50]
    spark.createDataFrame([((k * 7) % 1000 if k is not None else None,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    (part,) = (tmp_path / "supplier.parquet").glob("part-*.parquet")
    part.rename(tmp_path / "s.parquet")
    (tmp_path / "supplier.parquet").rename(tmp_path / "folder")
    (tmp_path / "s.parquet").rename(tmp_path / "supplier.parquet")
    tracker = spark.sparkContext.statusTracker()
    for rows, name in ((C.RANGE_ROWS, "one range"), (100, "ranges")):
        monkeypatch.setattr(C, "RANGE_ROWS", rows)
        spark.sparkContext.setJobGroup(name, name)
        try:
            mine, theirs = both(spark, tmp_path, catalog.QUERIES["batch_loop"], catalog.ORACLES["batch_loop"])
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert mine == theirs and len(mine) == 1140 and len(tracker.getJobIdsForGroup(name)) < 12
    assert C.numbered_batches(spark.range(0).toDF("k"), "k", 2).count() == 0
    text = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    assert sorted(tuple(r) for r in C.numbered_batches(text.filter("k IS NOT NULL"), "k", 2).collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_relations_are_joined_on_demand(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, owner int")
    owners = spark.createDataFrame([(10, "a", 5), (20, "b", 9), (10, "a", 7)], "key int, name string, age int")
    related = {"owner": C.Relation(owners, "owner", "key"), "other": C.Relation(owners, "id", "key")}
    plan = lambda asked: C.matching(rows, asked, related)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    both = C.Criteria(equal={"owner.name": "a", "id": 1}, at_least={"owner.age": 5}, like={"owner.name": "A"})
    assert [r.id for r in C.matching(rows, both, related).collect()] == [1] and plan(both) == 1
    assert plan(C.Criteria(equal={"id": 1, "owner.name": None})) == 0


def test_sql_functions(spark):
    from tessella.functions.sql import register

    register(spark)
    register(spark)
    row = spark.sql("SELECT size_text(1024) a, size_text(0) b, size_text(1536) c, strip_extension('x.tar.gz') d, base_name('a/b/c.md') e, normal_email(' A@B.co ') f, normal_email('a@b') g").head()
    assert tuple(row) == ("1 KB", "0 B", "1.5 KB", "x.tar", "c.md", "a@b.co", None)


def test_sources(spark, tmp_path):
    (tmp_path / "d" / "vendor").mkdir(parents=True)
    for name in ("d/a.md", "AGENTS.md", "d/b.php", "d/vendor/c.php", "d/tests.php"):
        (tmp_path / name).write_text("x")
    root = str(tmp_path / "d")
    assert [r.path for r in files.markdown_files(spark, str(tmp_path)).collect()] == [f"{root}/a.md"]
    php_ = files.without_directories(files.read_files(spark, [root], "*.php", (r".*/tests\.php$",)))
    assert [r.path for r in php_.collect()] == [f"{root}/b.php"]
    there = files.entries(spark, str(tmp_path))
    assert there.filter("is_dir").count() == 2
    asked = spark.createDataFrame([(f"{root}/vendor",), (f"{root}/no",)], "path string")
    assert {r.path.split("/")[-1]: r.exists for r in files.existing(asked, there).collect()} == {"vendor": True, "no": False}
    answers = spark.createDataFrame([('{"a": 1}',)], "body string")
    assert files.decoded(answers, "a int").head().decoded.a == 1
    with pytest.raises(Exception, match="decoded"):
        files.decoded(spark.createDataFrame([("{",)], "body string"), "a int").collect()


def test_external_service(spark):
    asked = spark.createDataFrame([(1, "hello"), (2, "you")], "id int, prompt string")

    def echo(body):
        given = __import__("json").loads(body)
        return '{"text": "%s!", "tokens": %d}' % (given["prompt"], given["id"])

    got = files.external(asked, echo, "text string, tokens int").collect()
    assert [(r.id, r.response.text, r.response.tokens) for r in got] == [(1, "hello!", 1), (2, "you!", 2)]
    for broken in (lambda body: "no json", lambda body: 1 / 0, files.post("http://127.0.0.1:9/", 0.2)):
        with pytest.raises(Exception, match="ExternalError"):
            files.external(asked, broken, "text string").collect()


def test_all_document_checks(spark):
    docs = spark.createDataFrame(X.DOCS, "path string, content string")
    there = spark.createDataFrame(X.ENTRIES, "path string, is_dir boolean, basename string, extension string")
    assert D.internal_links(docs).filter("path = 'docs/a.md'").count() == 4
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(D.front_matter_errors(docs)) == sorted(X.FRONT_MATTER_ERRORS) and rows(D.naming_errors(there)) == sorted(X.NAMING_ERRORS)
    assert rows(D.broken_links(docs, there)) == sorted(X.BROKEN_LINKS) and rows(D.missing_sections(docs)) == sorted(X.MISSING_SECTIONS)


def test_fixes_of_sources(spark):
    sources = spark.createDataFrame([(p, X.SOURCES[p][0]) for p in X.FIXED], "path string, content string")
    assert {r.path: r.content for r in P.fixed(php.units(sources)).collect()} == X.FIXED


def test_dispatch_after_commit(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "purchase", datetime(2024, 1, 1)), (2, "view", datetime(2024, 1, 1))], "event_id long, event_type string, ts timestamp").write.parquet(str(source))
    stream = spark.readStream.schema("event_id long, event_type string, ts timestamp").parquet(str(source))
    commands = events.commands(stream, F.col("event_type") == "purchase", {"event_id": F.col("event_id")})
    log = []

    def refuse(batch, number):
        log.append(("dispatch", number))
        raise OSError("broker is down")

    outbox = str(tmp_path / "outbox")
    q = events.after_commit(commands, lambda b, n: log.append(("commit", b.count())), events.with_outbox(refuse, outbox), str(tmp_path / "cp"))
    q.awaitTermination()
    assert log == [("commit", 1), ("dispatch", 0)]
    assert spark.read.parquet(outbox).head().attempts == 1
    assert events.relay(spark, lambda d: 1 / 0, outbox) == (0, 1)
    assert [(r.event_id, r.attempts, r.reason) for r in spark.read.parquet(outbox).collect()] == [(1, 2, "division by zero")]
    sent = []
    assert events.relay(spark, lambda d: sent.append([r.event_id for r in d.collect()]), outbox) == (1, 0)
    # What is published isn't published again.
    assert events.relay(spark, lambda d: sent.append(d.count()), outbox) == (0, 0) and sent == [[1]]


def test_failures_are_logged(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.range(3)
    events.with_failure_log(lambda b, n: None, log)(rows, 1)
    with pytest.raises(OSError):
        events.with_failure_log(lambda b, n: (_ for _ in ()).throw(OSError("no disk")), log)(rows, 7)
    (row,) = spark.read.parquet(log).collect()
    assert (row.batch, row.error) == (7, "OSError: no disk") and row["at"] is not None


def test_spread_leaves_what_is_large(spark):
    from tessella.sources.tables import SMALL, spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1).toDF("id"), "id").rdd.getNumPartitions() == cores
    wide = spark.range(cores * SMALL, numPartitions=3).toDF("id")
    assert spread(wide, "id") is wide


def test_names_behind_many_comments():
    far = " /* x */\n" * 60
    rows = php.tokenize(f"<?php class{far}A {{ function{far}f() {{}} }}")
    assert [(r["code"], r.get("name")) for r in rows if r["code"] in ("T_CLASS", "T_FUNCTION", "T_ANON_CLASS", "T_CLOSURE")] == [("T_CLASS", "A"), ("T_FUNCTION", "f")]


def test_tasks_have_a_bounded_number_of_files(spark, tmp_path):
    from tessella import catalog
    from tessella.sources.tables import KEYS

    def tasks(n):
        folder = tmp_path / str(n)
        spark.range(n, numPartitions=1).toDF("p_partkey").write.parquet(f"{folder}/part.parquet")
        return catalog.files(spark, str(folder)).rdd.getNumPartitions()

    cores = spark.sparkContext.defaultParallelism
    assert tasks(10) == cores and tasks(1_000_000) > max(cores, 4_000_000 // KEYS)


def test_files_share_batches_of_a_bounded_size(spark, monkeypatch):
    content = "<?php final class A { public function f(int $x) { return [$x, 'y']; } }"
    paths = pa.array([f"{i}.php" for i in range(300)])
    made = []
    one = spark.createDataFrame([("a", "b")], "path string, content string")
    monkeypatch.setattr(type(one), "mapInArrow", lambda self, run, schema: made.append(run))
    php.units(one)
    monkeypatch.undo()
    monkeypatch.setattr(php, "MOST_TOKENS", 1000)
    given = pa.RecordBatch.from_arrays([paths, pa.array([None, "", *[content] * 298])], ["path", "content"])
    out = list(made[0](iter([given, given.slice(0, 0)])))
    own = len(php.tokenize(content))
    assert pa.Table.from_batches(out)["path"].to_pylist() == paths.to_pylist()
    assert max(sum(map(len, b.column(1).to_pylist())) for b in out) < 1000 + own and len(out) == -(-298 * own // (-(-1000 // own) * own))
    assert pa.Table.from_batches(out)["tokens"].to_pylist() == [[], []] + [php.tokenize(content)] * 298


def test_documents_are_parsed_once_and_after_they_are_spread(spark, sf):
    from tessella import catalog

    for name in ("docs_totals", "docs_verdict", "docs_report", "docs_sections_missing"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        parsing = [i for i, line in enumerate(plan.split("\n")) if "^## .+" in line]
        shuffled = next(i for i, line in enumerate(plan.split("\n")) if "RepartitionByExpression" in line)
        assert len(parsing) == 1 and parsing[0] < shuffled, name


def test_all_errors_of_null_contents_and_paths(spark):
    docs = spark.createDataFrame([("a.md", None), (None, "[x](y.md)"), ("link", "---\ntype: rule\n---\n[x](a.md) [y](b.md)")], "path string, content string")
    there = spark.createDataFrame([("a.md", False), ("link", False)], "path string, is_dir boolean")
    got = sorted((r.check, r.path or "", r.line or 0, r.detail) for r in D.all_errors(docs, there).collect())
    apart = [("front-matter", r.path or "", 0, r.detail) for r in D.front_matter_errors(docs).collect()]
    apart += [("link", r.path or "", r.line, r.target) for r in D.broken_links(docs, there).collect()]
    apart += [("section", r.path, 0, r.detail) for r in D.missing_sections(docs).collect()]
    assert got == sorted(apart) and ("link", "link", 1, "b.md") in got and len([r for r in got if r[0] == "section"]) == 3
