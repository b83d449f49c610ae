"""Column functions over identifiers, paths and bounded text."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandgraph.functions import globs, ids
from strandgraph.schemas import REVERSE_LINKS


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_grammars(spark):
    L = F.lit  # noqa: N806
    r = row(
        spark,
        quoted=ids.loose_references(L('see `spec-auth-1` and SPEC-AUTH-2, "test-auth-3"')),
        case=ids.strict_case_references(L("SPEC-A-1 spec-a-2 ARCH-B-3")),
        changed=ids.annotation_ids(L("+// test-a-2 SPEC-A-1 SPEC-1-1 spec-a-1")),
        first=ids.report_identifier(L(None).cast("string"), L("about TEST-A-9"), L("SPEC-A-1")),
    )
    assert r.quoted == ["SPEC-AUTH-1", "TEST-AUTH-3"]
    assert r.case == ["SPEC-A-1", "ARCH-B-3"]
    assert r.changed == ["SPEC-A-1", "TEST-A-2"]
    assert r.first == "TEST-A-9"


def test_shapes(spark):
    cases = {"SPEC-AUTH-1": True, "spec-AUTH-1": True, "SPEC--1": True, "SPEC-AUTH-": True, "SPEC-auth-1": False, "SPEC-A-1-2": False, "NOTE-A-1": False}
    rows = spark.createDataFrame(list(cases), "string").select("value", ids.well_formed(F.col("value")).alias("ok")).collect()
    assert {r.value: r.ok for r in rows} == cases


def test_inference(spark):
    refs = ["SPEC-A_B-1", "TEST-X-2", "contract:pkg/x#N", "component:pkg/x#N", "orders:12", "plain"]
    rows = {r[0]: r[1:] for r in spark.createDataFrame(refs, "string").select("value", ids.type_of(F.col("value")), ids.kind_of(F.col("value")), ids.namespace_of(F.col("value"))).collect()}
    assert rows["SPEC-A_B-1"] == ("SPEC", "spec", "A_B")
    assert rows["contract:pkg/x#N"] == ("CONTRACT", "contract", "pkg/x")
    assert rows["component:pkg/x#N"] == ("DESIGN", "component", "pkg/x")
    assert rows["orders:12"] == (None, "orders", "12")
    assert rows["plain"] == (None, None, "")
    links = [("SPEC", "TEST-A-1", "tests"), ("SPEC", "contract:p#N", "contract"), ("TEST", "contract:p#N", "contract_tests"), ("TEST", "SPEC-A-1", "implements"), ("CONTRACT", "SPEC-A-1", "contract_implements"), ("DESIGN", "SPEC-A-1", "references")]
    found = spark.createDataFrame(links, "t string, r string, want string").select("want", ids.trace_link_type(F.col("t"), F.col("r")).alias("got")).collect()
    assert all(x.want == x.got for x in found)


def test_lists_and_names(spark):
    L = F.lit  # noqa: N806
    r = row(
        spark,
        refs=ids.split_refs(L(" a , ,b")),
        kept=ids.split_refs(L("a,,b"), keep_empty=True),
        ticks=ids.reference_list(L("`a b`, `c`,")),
        head=ids.heading_id(L("SPEC-A-1: A title: more")),
        title=ids.heading_title(L("SPEC-A-1: A title: more")),
        key=ids.field_key(L(" Depends  on ")),
        life=ids.lifecycle(L("`Planned`")),
        none=ids.lifecycle(L(None).cast("string")),
        package=ids.package_of(L("internal/docs/graph/spec.md")),
        plain=ids.package_of(L("docs/a/docs/b/spec.md")),
        module=ids.module_of(L("internal/my-pkg")),
        scope=ids.scope_of(L("p/q#N"), L("own")),
        local=ids.local_name(L("p/q#N")),
        path=ids.location_path(L("a/b.md:12")),
        line=ids.location_line(L("a/b.md:12")),
        no_line=ids.location_line(L("a/b.md")),
        slug=ids.slug(L(" Depends on! ")),
        lines=ids.line_count(L("a\nb")),
        lines2=ids.line_count(L("a\nb\n")),
        empty=ids.line_count(L("")),
        status=ids.change_status(L("R100")),
    )
    assert (r.refs, r.kept, r.ticks) == (["a", "b"], ["a", "", "b"], ["a b", "c"])
    assert (r.head, r.title, r.key, r.life, r.none) == ("SPEC-A-1", "A title: more", "depends-on", "planned", "active")
    assert (r.package, r.plain, r.module, r.scope, r.local) == ("internal/graph", "docs/a/b", "INTERNAL_MY_PKG", "p/q", "N")
    assert (r.path, r.line, r.no_line, r.slug) == ("a/b.md", 12, None, "depends-on")
    assert (r.lines, r.lines2, r.empty, r.status) == (2, 2, 0, "renamed")


def test_placeholders(spark):
    values = [("TBD", False, False), ("todo", False, False), ("text", False, True), ("", False, False), (None, False, False), ("a, TODO", True, False), ("a,b", True, True), (" , ", True, False)]
    rows = spark.createDataFrame(values, "v string, l boolean, want boolean").select("want", ids.complete(F.col("v"), F.col("l")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_cut_bytes_never_splits_a_character(spark):
    texts = ["", "abc", "abcdefgh", "äöüß", "a€€€", "😀😀😀", "ab😀"]
    for limit in (0, 1, 4, 5, 7, 8):
        for r in spark.createDataFrame(texts, "string").select("value", ids.cut_bytes(F.col("value"), limit).alias("cut")).collect():
            assert r.cut == r.value.encode()[:limit].decode(errors="ignore")


def test_reverse_types():
    assert all(REVERSE_LINKS[REVERSE_LINKS[t]] == t for t in REVERSE_LINKS)
    assert len(REVERSE_LINKS) == 17


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=2), min_size=1, max_size=4))
def test_globs(parts):
    import re

    path = "/".join(parts)
    assert re.match(globs.glob_regex("**"), path)
    assert re.match(globs.glob_regex("**/*"), path)
    assert bool(re.match(globs.glob_regex("*"), path)) == (len(parts) == 1)
    assert re.match(globs.glob_regex("**/" + parts[-1]), path)
    assert re.match(globs.glob_regex("{x," + path + "}"), path)


def test_ignored(spark):
    paths = {"vendor/a.go": True, "src/vendor/a.go": True, "src/a.go": False, "src/a.gen.go": True}
    rows = spark.createDataFrame(list(paths), "string").select("value", globs.ignored(F.col("value"), ["vendor/**", "*.gen.go"]).alias("x")).collect()
    assert {r.value: r.x for r in rows} == paths
