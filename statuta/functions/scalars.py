"""Scalar functions of the record jobs, as column expressions.

Unknown stays null: a date that can't be read is null and never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"

# fixed values: words about an effective date, and words that admit not knowing it
DATE_TOPICS = ("生效日", "施行日", "effective_from", "生效时间", "施行时间")
DATE_UNCERTAIN = ("需人工", "待核验", "待确认", "待核实", "待补充", "待定", "未确认", "尚未确认", "未明确", "尚未明确", "未予明确", "不明确", "无法确认", "难以确认", "不能确认", "需确认", "需核实", "尚未核验", "未载明", "未查到", "未获", "有待核实", "存疑", "尚需", "未知")
DATE_NEGATION = "(尚未|还未|仍未|未曾|未经|未|没有|无)[^，。；]{0,12}(载明|明确|确认|核验|核实|写明|注明|查证|取得|掌握)"
STATUS_WORDS = "施行|生效|废止|修订|之日起"
SOFT_WORDS = ("鼓励", "支持", "提倡", "引导")
MANDATORY_WORDS = ("应当", "必须", "不得", "禁止", "严禁")
TITLE_SEPARATORS = ("_", "—", "-", "|", "－")
# fixed values: date and clause patterns
CHINESE_NUMBER = "(?:[0-9]{1,2}|十?[一二三四五六七八九]|[一二三]?十[一二三四五六七八九]?)"
EFFECTIVE_DATE = f"自\\s*([0-9]{{4}}|[〇零一二三四五六七八九]{{4}})\\s*年\\s*({CHINESE_NUMBER})\\s*月\\s*({CHINESE_NUMBER})\\s*日\\s*起?\\s*(?:施行|生效)"
NEXT_CLAUSE = "第\\s*[0-9一二三四五六七八九十]+\\s*条"
CLAUSE_HEAD = "(?:第\\s*(?:[0-9]+|[一二三四五六七八九十]+)\\s*条|（\\s*(?:[0-9]+|[一二三四五六七八九十]+)\\s*）)"
DOC_NUMBER = "〔[^〕]*〕\\s*第?\\s*[0-9]+\\s*号?"
TITLE_NOISE = "(\\[?附件[0-9]*\\]?|【.*?】|\\(.*?\\)|（.*?）)$"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def trimmed(c: Column) -> Column:
    """Without white space at both ends, full-width and no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def spaced(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def any_word(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def normalize_text(c: Column) -> Column:
    """Lines trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, LINE_BREAKS), trimmed), lambda x: x != ""), "\n")


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(c, "utf-8"), 256))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.when(y.cast("int") > 0, F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d")).cast("date"))


def parse_date(c: Column) -> Column:
    """The date in a text: Chinese form, then year first, then two-digit year. The first form
    that occurs decides; if its date doesn't exist the result is null."""
    forms = (r"([0-9]{4})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日", r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", r"(?U)\b([0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\b")
    out = F.lit(None).cast("date")
    for k, form in reversed(list(enumerate(forms))):
        y, m, d = (F.regexp_extract(c, form, g) for g in (1, 2, 3))
        out = F.when(c.rlike(form), _date(F.concat(F.lit("20"), y) if k == 2 else y, m, d)).otherwise(out)
    return out


def coerced_date(c: Column) -> Column:
    """The ISO date that a text begins with; null if it has none."""
    return F.try_to_date(F.when(F.substring(c, 1, 10).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.substring(c, 1, 10)), "yyyy-MM-dd")


def page_url(list_url: Column, pattern: Column, page: Column, one_based: bool = False) -> Column:
    """Address of a list's page: the list's own for the first, then the pattern with the page's number, from 0 or from 1."""
    number = (page if one_based else page - 1).cast("string")
    return F.when(page <= 1, list_url).otherwise(F.replace(pattern, F.lit("{page}"), number))


def request_url(base: Column, params: Column, channel: Column, page: Column, page_size: Column) -> Column:
    """base?k=v&...: params in their order, with {channel_id}, {page} and {page_size} filled in."""

    def filled(value: Column) -> Column:
        for name, c in (("{channel_id}", channel), ("{page}", page), ("{page_size}", page_size)):
            value = F.replace(value, F.lit(name), c.cast("string"))
        return value

    pairs = F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), filled(e["value"])))
    return F.when(F.size(params) > 0, F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.array_join(pairs, "&"))).otherwise(base)


def iso_json(*columns) -> Column:
    """A JSON object of the columns, with dates in ISO form at any depth and nulls kept."""
    return F.to_json(F.struct(*columns), {"dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"})


def clean_title(c: Column) -> Column:
    """White space made single; trailing bracketed remarks and attachment marks removed, layer by layer."""
    text = spaced(F.coalesce(c, F.lit("")))
    layers = F.length(F.regexp_replace(text, r"[^\]】)）件]", ""))
    return F.aggregate(F.sequence(F.lit(0), layers), text, lambda acc, _: spaced(F.regexp_replace(acc, TITLE_NOISE, "")))


def epoch_date(c: Column) -> Column:
    """The civil date at UTC+8 of an epoch in seconds or milliseconds, given as digits; null for anything else."""
    n = F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("bigint"))
    seconds = F.when(n > 10_000_000_000, F.floor(n / 1000)).otherwise(n)
    days = F.floor((seconds + 28800) / 86400)
    return F.when((n >= 10_000_000) & (days < 2932897), F.date_from_unix_date(days.cast("int")))


def any_date(c: Column) -> Column:
    return F.coalesce(epoch_date(c), parse_date(c))


def render_template(template: Column, item: Column) -> Column:
    """{field} of the template filled from a map; null if a field is missing or a brace is left."""
    fields = F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1))
    bad = F.exists(fields, lambda f: F.coalesce(item[f].rlike(r"[{}]"), F.lit(True)))
    out = F.aggregate(fields, template, lambda acc, f: F.replace(acc, F.concat(F.lit("{"), f, F.lit("}")), F.coalesce(item[f], F.lit(""))))
    return F.when((template != "") & ~bad & ~out.rlike(r"[{}]"), out)


def url_path_depth(c: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def absolute_url(href: Column, base: Column) -> Column:
    scheme, root = F.regexp_extract(base, "^([a-z]+:)", 1), F.regexp_extract(base, "^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^:/])/[^/]*$", "")
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))


def is_home_path(c: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.lower(path).isin("", "/", "/index.html", "/index.htm", "/index.jsp", "/index.shtml", "/home", "/home/")


def squash(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def shorten(c: Column, most: int = 60) -> Column:
    flat = spaced(F.coalesce(c, F.lit("")))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def chinese_to_int(c: Column) -> Column:
    """十 forms up to 99, else digit by digit; null if any other character occurs."""

    def read(text: Column) -> Column:
        left, right = F.substring_index(text, "十", 1), F.regexp_extract(text, "十(.*)$", 1)
        tens = F.when(left == "", F.lit(1)).otherwise(left.try_cast("int"))
        ones = F.when(right == "", F.lit(0)).otherwise(right.try_cast("int"))
        return F.when(text.rlike("^[0-9]?十[0-9]?$"), tens * 10 + ones).when(text.rlike("^[0-9]+$"), text.try_cast("int"))

    plain = trimmed(c)
    return bound(F.when(~plain.rlike("[0-9]"), F.translate(plain, "〇零一二两三四五六七八九", "001223456789")), read)


def number_to_int(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).otherwise(chinese_to_int(c))


def int_to_chinese(c: Column) -> Column:
    """1 to 99, else null."""

    def write(n: Column) -> Column:
        digit = lambda k: F.substring(F.lit("一二三四五六七八九"), k.cast("int"), F.lit(1))
        tens, tail = F.floor(n / 10), F.when(n % 10 == 0, F.lit("")).otherwise(digit(n % 10))
        return F.when((n >= 1) & (n <= 9), digit(n)).when((n >= 10) & (n <= 19), F.concat(F.lit("十"), tail)).when((n >= 20) & (n <= 99), F.concat(digit(tens), F.lit("十"), tail))

    return bound(c, write)


def effective_dates(c: Column) -> Column:
    """The existing dates of every "from … in force" phrase, distinct, in order."""
    y, m, d = (F.regexp_extract_all(c, F.lit(EFFECTIVE_DATE), F.lit(g)) for g in (1, 2, 3))
    dates = F.transform(F.arrays_zip(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: _date(number_to_int(x["y"]).cast("string"), number_to_int(x["m"]).cast("string"), number_to_int(x["d"]).cast("string")))
    return F.array_distinct(F.array_compact(dates))


def _sentences(c: Column, breaks: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), breaks), trimmed), lambda x: x != "")


def status_sentences(c: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.filter(_sentences(c, "[。；\n]"), lambda x: x.rlike(STATUS_WORDS))), 1, most)


def status_hits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(STATUS_WORDS))


def unconfirmed_sentence(c: Column) -> Column:
    """The first sentence of a note that admits the effective date isn't confirmed; null if none does."""
    hit = lambda x: any_word(x, DATE_TOPICS) & (any_word(x, DATE_UNCERTAIN) | x.rlike(DATE_NEGATION))
    return F.get(F.filter(_sentences(c, "[。；;\n]"), hit), 0)


def title_candidates(c: Column) -> Column:
    """A page title as it is and without document number and quotes, each also up to each separator."""
    plain = trimmed(F.regexp_replace(F.regexp_replace(c, DOC_NUMBER, ""), "[《》]", ""))
    forms = [x for base in (trimmed(c), plain) for x in (base, *[trimmed(F.substring_index(base, s, 1)) for s in TITLE_SEPARATORS])]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x != ""))


def clause_number(c: Column) -> Column:
    """The number that a clause names: its first in digits, else its Chinese one; null if it has none."""
    arabic = F.regexp_extract(c, "([0-9]+)", 1)
    return F.when(arabic != "", arabic.try_cast("int")).otherwise(chinese_to_int(F.regexp_replace(c, r"(?U)[第条\s（）()]", "")))


def clause_pattern(c: Column) -> Column:
    """A pattern for the clause in either script; null if the clause has no number."""
    forms = bound(clause_number(c), lambda k: F.when(k.isNotNull(), F.concat_ws("|", k.cast("string"), int_to_chinese(k))))
    return bound(forms, lambda f: F.concat(F.lit("第\\s*(?:"), f, F.lit(")\\s*条|（\\s*(?:"), f, F.lit(")\\s*）")))


def clause_position(text: Column, clause: Column) -> Column:
    """1-based place of the clause in the text, 0 if it isn't there."""
    return bound(clause_pattern(clause), lambda p: F.when(p.isNotNull(), F.regexp_instr(text, p)).otherwise(F.position(trimmed(clause), text)))


def clause_paragraph(text: Column, at: Column) -> Column:
    """From a clause to the next one."""
    rest = F.substring(text, at + 3, F.length(text))
    nxt = F.regexp_instr(rest, F.lit(NEXT_CLAUSE))
    return F.when(nxt > 0, F.substring(text, at, nxt + 2)).otherwise(F.substring(text, at, F.length(text)))
