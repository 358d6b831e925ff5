"""Case tables of single operators."""

from __future__ import annotations

import datetime as dt
import difflib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from statuta.functions import scalars as S
from statuta.operators import catalog, cleaning, diffing, enforcement, evidence, promotion, validation
from statuta.sources import html, listing, records


def values(spark, fn, cases, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


D = dt.date
CASES = [
    (S.parse_date, {"2026年6月18日": D(2026, 6, 18), "发布 2026-06-18 10:00": D(2026, 6, 18), "2026/6/1": D(2026, 6, 1), "26-06-18": D(2026, 6, 18), "2026-02-30": None, "2026年2月30日 2026-01-01": None, "no": None, "": None}),
    (S.clean_title, {"规定【最新】(附件)": "规定", "关于 X\n的　通知 ": "关于 X 的 通知", "（甲）正文（乙）": "", "甲（1）乙": "甲（1）乙", "表附件2": "表", "": ""}),
    (S.epoch_date, {"1786847417000": D(2026, 8, 16), "1786847417": D(2026, 8, 16), "9999999": None, "x": None, "99999999999999999999": None}),
    (S.url_path_depth, {"http://a.b/c/d.html?x=/y#z": 2, "http://a.b/": 0, "http://a.b": 0, "http://a.b//c/": 1}),
    (S.normalize_text, {" a　\r\n\n  b\x0bc ": "a\nb\nc", "": ""}),
    (S.squash, {"《某 办法》\n第1条": "某办法第1条", "—— ": ""}),
    (S.chinese_to_int, {"十": 10, "十六": 16, "二十": 20, "九十九": 99, "二〇二一": 2021, "两": 2, "百": None, "": None}),
    (S.unconfirmed_sentence, {"已核验生效日期为 2023-08-15；另有实施细则尚未明确": None, "未在公开摘录中明确写出施行日期条款": "未在公开摘录中明确写出施行日期条款", "生效日期未在公开摘录中明确写出": "生效日期未在公开摘录中明确写出", "甲。effective_from 需人工核验": "effective_from 需人工核验"}),
    (lambda c: S.shorten(c, 3), {"abcd": "abc…", "a\n b": "a b", "": ""}),
    (S.is_home_path, {"http://a.b/": True, "http://a.b/index.html?x": True, "http://a.b/c": False}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=range(len(CASES)))
def test_scalars(spark, fn, cases):
    assert dict(zip(cases, values(spark, fn, list(cases)), strict=True)) == cases


def test_effective_dates_and_sentences(spark):
    text = "自2021年11月1日起施行。自 二〇二一 年十一月二十一日起生效；自2021年11月1日施行\n自2026年2月30日起施行，旧规同时废止。"
    assert values(spark, S.effective_dates, [text]) == [[D(2021, 11, 1), D(2021, 11, 21)]]
    assert len(values(spark, S.status_sentences, [text])[0]) == 4


def test_template(spark):
    df = spark.createDataFrame([({"id": "7"},), ({"x": "7"},), ({"id": "{x}"},)], "m map<string,string>")
    out = [r[0] for r in df.select(S.render_template(F.lit("http://x/?id={id}"), F.col("m"))).collect()]
    assert out == ["http://x/?id=7", None, None]


def test_clauses(spark):
    df = spark.createDataFrame([("第十六条 应当。第17条 x", "16"), ("甲（ 一 ）乙", "（一）"), ("见附件", "附件"), ("第1条", "二")], "t string, c string")
    at = S.clause_position(F.col("t"), F.col("c"))
    got = [(r[0], r[1]) for r in df.select(at, S.clause_paragraph(F.col("t"), at)).collect()]
    assert got[0] == (1, "第十六条 应当。") and got[1] == (2, "（ 一 ）乙") and got[2][0] == 2 and got[3][0] == 0


DOCS = [(1, "s", "关于人工智能的通知", "http://l/a/b/1", None, {}), (2, "s", "关于人工智能的通知二", "http://l/a/b/1", None, {}), (3, "s", "首页", "http://l/a", None, {}), (4, "s", "银行年报", "http://l/a/b/2", D(2026, 1, 1), {}), (5, "s", "关于数据的处罚", "http://l/a/b/3", D(2026, 1, 1), {"violation_type": "人工智能"}), (6, "s", "招聘人工智能", "http://l/a/b/4", D(2026, 1, 1), {})]
REG = [("s", "i", True, "html_list", "http://l/a/list.html", ["人工智能", " "], ["招聘"]), ("empty", "i", True, "html_list", "http://m/", [], [])]


def test_cleaning(spark):
    docs = spark.createDataFrame(DOCS, "seq long, source_id string, title string, url string, published_on date, extra map<string,string>").repartition(3)
    reg = spark.createDataFrame(REG, "id string, issuer_code string, enabled boolean, fetcher string, list_url string, include_keywords array<string>, exclude_keywords array<string>")
    kept = cleaning.dedupe_by_url(docs)
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4, 5, 6]
    marked = cleaning.with_drop_reason(kept, reg)
    assert {r.seq: r.drop_reason for r in marked.collect()} == {1: None, 3: "navigation", 4: "not_matched", 5: None, 6: "excluded"}
    report = {r.source_id: r for r in cleaning.cleaning_report(reg, marked).collect()}
    assert report["s"].found == 5 == report["s"].kept + 3 and report["empty"].status == "degraded" and report["s"].status == "ok"


def test_stale_boundary(spark):
    p = spark.createDataFrame([("a", D(2026, 1, 1)), ("b", D(2025, 12, 31))], "id string, last_verified date")
    assert [(r.id, r.days) for r in diffing.stale_records(p, "2026-06-30").collect()] == [("b", 181)]


def test_merge_is_idempotent(spark):
    schema = "detected_on date, change_type string, policy_id string, url string, significance string"
    a = spark.createDataFrame([(D(2026, 1, 1), "new", "p", None, "low"), (D(2026, 1, 1), "new", "q", "u", "low")], schema)
    b = spark.createDataFrame([(D(2026, 1, 1), "new", "p", "", "high")], schema)
    once = diffing.merge_changes(a, b).drop("kept")
    twice = diffing.merge_changes(once, b).drop("kept")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 2
    assert diffing.merge_outcome(a, b).first().asDict() == {"detected_on": D(2026, 1, 1), "total": 2, "added": 0, "replaced": 1, "kept": 1}


def test_missing_hash_is_no_change(spark):
    cols = "id string, status string, content_hash string, effective_from date, effective_until date, superseded_by string, n_obligations long, last_verified date, ai_relevance string, url string"
    row = lambda h, s="effective", e=None: ("a", s, h, e, None, None, 1, D(2026, 1, 1), "core", "u")
    diff = lambda o, n: sorted((r.change_type, r.significance, *r.fields) for r in diffing.snapshot_changes(spark.createDataFrame([o], cols), spark.createDataFrame([n], cols), "2026-01-02").collect())
    assert diff(row(None), row("x")) == [] and diff(row("y"), row("x")) == [("content_changed", "high", "content_hash")]
    assert diff(row("x"), row("x", "repealed", D(2026, 1, 1))) == [("metadata_changed", "low", "effective_from"), ("status_changed", "high", "status")]


def test_penalty_table_columns_by_header(spark):
    cells = [["公示表"], ["备注", "行政处罚决定书\n文号", "违法行为 类型", "当事人　名称"], ["x", "D1", "v" * 70, "甲"], ["合并"], ["y", "", "", "乙"], ["z", "D2", "v", ""]]
    pages = spark.createDataFrame([("http://p", "s", None, cells), ("http://q", "s", None, [["无", "表"]])], "url string, source_id string, published_on date, cells array<array<string>>")
    rows = enforcement.penalty_rows(pages)
    got = {r.party: r for r in rows.collect()}
    assert set(got) == {"甲", "乙"} and got["甲"].title == "甲｜" + "v" * 60 + "…" and len(got["甲"].violation_type) == 70
    assert got["甲"].url == "http://p#D1" and got["乙"].url == "http://p#乙" and got["乙"].title == "乙" and got["甲"].authority == ""
    assert enforcement.detail_outcome(pages, rows).first().outcome == "warning"


RECORD = "policy_id string, url string, title string, doc_number string, effective_from date, status_code int, error string, final_url string, body_text string, usable boolean, content_hash string, page_title string, key_obligations array<struct<clause:string,summary:string,obligation_type:string>>"


def record(**k):
    base = {"policy_id": "p", "url": "http://a/1", "title": "某办法", "doc_number": None, "effective_from": None, "status_code": 200, "error": None, "final_url": "http://a/1", "body_text": "某办法\n第一条 银行应当报告数据。第二条 鼓励创新。", "usable": True, "content_hash": None, "page_title": "某办法_站", "key_obligations": []}
    return tuple((base | k).values())


@pytest.mark.parametrize(
    "layer,changes,status",
    [
        ("reachability", {}, "ok"),
        ("reachability", {"status_code": None, "error": "timeout"}, "error"),
        ("reachability", {"status_code": 404}, "error"),
        ("reachability", {"final_url": "http://a/"}, "error"),
        ("reachability", {"content_hash": "sha256:0"}, "warning"),
        ("titles", {}, "ok"),
        ("titles", {"page_title": None}, "manual"),
        ("titles", {"page_title": "首页", "body_text": "无关"}, "manual"),
        ("titles", {"page_title": "首页"}, "ok"),
        ("titles", {"page_title": "首页", "body_text": "银发1号", "doc_number": "银发1号"}, "error"),
        ("dates", {}, "ok"),
        ("dates", {"usable": False}, "manual"),
        ("dates", {"effective_from": D(2026, 1, 1)}, "error"),
        ("dates", {"effective_from": D(2026, 1, 1), "body_text": "菜单"}, "manual"),
        ("dates", {"effective_from": D(2026, 1, 1), "body_text": "某办法自2026年1月1日起施行"}, "ok"),
        ("dates", {"effective_from": D(2026, 1, 2), "body_text": "某办法自2026年1月1日起施行"}, "warning"),
        ("dates", {"body_text": "某办法自2026年1月1日起施行"}, "warning"),
        ("obligations", {}, "ok"),
        ("obligations", {"key_obligations": [("一", "银行应当报告数据", "mandatory")]}, "ok"),
        ("obligations", {"key_obligations": [("1", "银行应当报告数据", "encouraged")]}, "error"),
        ("obligations", {"key_obligations": [("二", "鼓励创新", "mandatory")]}, "error"),
        ("obligations", {"key_obligations": [("一", "zzzz", "mandatory")]}, "error"),
        ("obligations", {"key_obligations": [("九", "无", "mandatory")]}, "error"),
        ("obligations", {"key_obligations": [("九", "无", "mandatory")], "body_text": "菜单"}, "manual"),
        ("obligations", {"key_obligations": [("一", "无", "mandatory")], "usable": False}, "manual"),
    ],
)
def test_evidence_branches(spark, layer, changes, status):
    r = spark.createDataFrame([record(**changes)], RECORD)
    assert [c.status for c in getattr(evidence, layer)(r).collect()] == [status]


def test_attachments_are_searched_after_the_page(spark):
    r = spark.createDataFrame([record(key_obligations=[("九", "银行应当备案", "mandatory")])], RECORD)
    spaces = lambda *rows: spark.createDataFrame(rows, "policy_id string, rank int, status string, text string")
    got = lambda s: evidence.obligations(r, s).first().status
    assert got(spaces(("p", 1, "extracted", "第九条 银行应当备案"))) == "ok"
    assert got(spaces(("p", 1, "extracted", "无"))) == "error" and got(spaces(("p", 1, "failed", None))) == "manual"


def test_ratio_is_difflib(spark):
    pairs = [("银行应当报告", "第一条 银行应当报告数据。" * 30), ("", ""), ("abc", "acb")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(evidence.ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_cards_and_promotion(spark):
    r = spark.createDataFrame([record(effective_from=D(2026, 1, 2), body_text="某办法自2026年1月1日起施行 第一条 应当。", key_obligations=[("一", "应当", "mandatory"), ("九", "无", "mandatory")])], RECORD)
    checks = evidence.checks(r)
    card = evidence.cards(checks).first()
    assert [c.check_id for c in card.checks] == ["reachability", "title", "date", "obligation:0", "obligation:1"] and card.pending_count == 2
    decisions = spark.createDataFrame([("p", "date", "adopt:2026-01-01", "1"), ("p", "obligation:1", "drop-obligation", "1"), ("p", "date", "no-such", "0")], "policy_id string, check_id string, option_key string, ts string")
    good, bad = promotion.valid_decisions(decisions, checks)
    assert good.count() == 2 and bad.count() == 1
    assert promotion.blocked(checks, decisions).count() == 0 and promotion.blocked(checks, decisions.limit(0)).count() == 2
    drafts = r.select(F.col("policy_id").alias("id"), "effective_from", "key_obligations", F.lit("automated").alias("verified_by"), F.lit(None).cast("date").alias("last_verified"), F.lit(None).cast("string").alias("verified_note"))
    done = promotion.apply_decisions(drafts, good, "2026-02-02").first()
    assert done.effective_from == D(2026, 1, 1) and len(done.key_obligations) == 1 and done.verified_by == "human" and done.last_verified == D(2026, 2, 2)
    published = spark.createDataFrame([("x",)], "id string")
    assert promotion.gate(drafts, checks, decisions.limit(0), published).first().outcome == "blocked"
    assert promotion.gate(drafts, checks, decisions.limit(0), published, "auto").first().outcome == "promote"
    left, refused = promotion.reject(drafts, spark.createDataFrame([("p", " "), ("q", "why")], "policy_id string, reason string"))
    assert left.count() == 1 and refused.count() == 2


def test_version_as_of(spark):
    v = spark.createDataFrame([("a", [(1, "amended", D(2020, 1, 1), D(2022, 1, 1)), (2, "effective", D(2022, 1, 1), None)])], "id string, versions array<struct<version:int,status:string,effective_from:date,effective_until:date>>")
    assert catalog.version_as_of(v, "2021-12-31").first().version == 1 and catalog.version_as_of(v, "2022-01-01").first().version == 2
    assert catalog.version_as_of(v, "2019-01-01").count() == 0


def test_shape(spark):
    df = spark.createDataFrame([("ok-1-2", "Title", None), ("BAD", "x", "secondary")], "id string, title string, status string")
    found = {(r.record_id, r.rule) for r in validation.shape_issues(df, {k: validation.POLICY_SHAPE[k] for k in ("id", "title", "status", "issuer")}).collect()}
    assert found == {("ok-1-2", "status:required"), ("ok-1-2", "issuer:required"), ("BAD", "id:pattern"), ("BAD", "id:min_length"), ("BAD", "title:min_length"), ("BAD", "status:enum"), ("BAD", "issuer:required")}


def test_json_paths(spark):
    rows = [(json.dumps({"data": {"list": [{"a": 1}, 3, {"a": None}]}}),), (json.dumps({"rows": []}),), ("no json",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(listing.items(F.col("p"))).collect()]
    assert got == [[{"a": "1"}, {"a": None}], [], []]


def test_page_and_docx(spark):
    page = html.read_page("<title>T</title><p>a<script>x</script>b</p><table><tr><th>h<td>1</tr></table><a href='x.PDF?q'>l</a>")
    assert page["title"] == "T" and "x" not in page["text"].split() and page["cells"] == [["h", "1"]]
    pages = spark.createDataFrame([("http://a/b/c.html", "<a href='x.PDF?q'>one</a><a href='/y.doc'>two</a><a href='x.PDF?q'>one</a><a href='mailto:z'>m</a>")], "url string, html string")
    assert {(r.href, r.extension) for r in html.attachment_links(pages).collect()} == {("http://a/b/x.PDF?q", "pdf"), ("http://a/y.doc", "doc")}
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p><w:t>c</w:t></w:p></w:document>')
    got = [r[0] for r in spark.createDataFrame([(bytearray(raw.getvalue()),), (bytearray(b"x"),)], "c binary").select(html.docx_text("c")).collect()]
    assert got == ["ab\nc", None]


def test_record_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: x-1\ntitle: One\npublished_on: 2026-01-02\n")
    (tmp_path / "b.yaml").write_text("id: x-1\ntitle: Two\n")
    (tmp_path / "c.yaml").write_text("a: [\n")
    good, issues = records.load_records(spark, str(tmp_path))
    assert [(r.id, r.title, r.published_on) for r in good.collect()] == [("x-1", "One", D(2026, 1, 2))]
    assert sorted(r.rule for r in issues.collect()) == ["duplicate_id", "unreadable"]
    none, _ = records.load_records(spark, str(tmp_path / "absent"))
    assert none.count() == 0


def test_change_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"detected_on": "2026-01-01", "changes": [{"change_type": "new", "policy_id": "p"}]}))
    (tmp_path / "2.json").write_text("{broken")
    rows, bad = records.load_change_days(spark, str(tmp_path))
    assert [(r.day, r.policy_id) for r in rows.collect()] == [("2026-01-01", "p")] and bad.count() == 1


def test_list_rows_by_selectors(spark):
    from statuta.sources import html as h

    table = "<a href='/menu'>Menu of the site</a><div id=main><table class='rows x'><tr><td><a href='d/1.html'>Rules one【新】</a><td>n</td><td>2026-01-05</td></tr><tr><td><a href='javascript:x'>Rules two</a></td></tr><tr><td><a href='/3'>abc</a></td></tr><tr><td><a href='/4'>Rules four</a><td>（2025年3月4日）<td>none</table></div><footer><a href='/f'>Footer of 2020-01-01</a></footer>"
    items = "<ul id=l><li><h5>Rules five</h5><a href='/5'>more</a><div class='a times'>2026-02-03</div><p>seen 2026-09-09<li><h5>Rules six</h5><a href='/6'>more</a> 2024-5-6<li>no link</ul><ul><li><h5>Related</h5><a href='/r'>more</a></ul>"
    sel = [("s", "http://l/a/x.html", table, {"item": "#main table.rows tr", "date": "td:last-child"}), ("t", "http://m/", items, {"item": "#l li", "title": "h5", "date": "div.times"}), ("u", "http://n/", items, {}), ("v", "http://o/", None, {"item": "li"})]
    got = h.list_docs(spark.createDataFrame(sel, "source_id string, url string, html string, selectors map<string,string>")).collect()
    want = {("s", "Rules one", "http://l/a/d/1.html", dt.date(2026, 1, 5)), ("s", "Rules four", "http://l/4", dt.date(2025, 3, 4)), ("t", "Rules five", "http://m/5", dt.date(2026, 2, 3)), ("t", "Rules six", "http://m/6", dt.date(2024, 5, 6))}
    assert {(r.source_id, r.title, r.url, r.published_on) for r in got} == want and len(got) == 4
    with pytest.raises(ValueError):
        h.selector("li > a")


def test_links_are_counted_page_by_page(spark, tmp_path):
    from statuta.plans import QUERIES

    item = "<li><a href='/d'>one</a>"
    rows = [(1, "http://a/", item * 2), (2, "http://a/", item * 3), (3, "http://a/b", "<p>none</p><a href='mailto:z'>m</a>"), (4, "http://a/c", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.url, r.links) for r in QUERIES["page_links"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [("http://a/", 2), ("http://a/", 3), ("http://a/b", 0), ("http://a/c", None)]
    listed = html.page_links(spark.read.parquet(f"{tmp_path}/pages.parquet").filter("page_id in (2, 3)")).collect()
    assert [(r.url, r.at, r.text, r.href) for r in listed] == [("http://a/", i, "one", "http://a/d") for i in range(3)]
