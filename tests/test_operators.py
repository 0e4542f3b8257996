"""Operators against plain Python, and their edge cases."""

import hashlib
import hmac
import random
import re
import unicodedata

import pytest
from maskwright import Config, Masker
from maskwright.functions import dummy, geometry, patterns as P, tokens
from maskwright.functions.normalize import normalize
from maskwright.operators import canonical, detect, fields as ops, mask as masking, replace as rep, report, responses, verify as ver
from maskwright.plans import queries as registered
from maskwright.sources import blocks as src, store
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def blocks(spark, *texts, confidence=0.9):
    return spark.createDataFrame([(1, 1, k, f"block_1_{k}", t, [0, k * 20, 100, k * 20 + 16], confidence) for k, t in enumerate(texts)], src.SCHEMA)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Contact: john@example.com", {"email"}),
        ("no-at-sign.example.com " + "a" * 50_000, set()),
        ("a" * 50_000 + "@b.co", {"email"}),
        ("Server 10.0.0.1 up", {"ip_address"}),
        ("é123-45-6789", set()),  # a letter before: no word boundary
        ("id 123-45-6789", {"ssn_us"}),
        ("id ١٢٣-٤٥-٦٧٨٩", {"ssn_us"}),  # any digits of Unicode
        ("AB 12 34 56 C", {"nino_uk"}),
        ("1 85 05 78 006 084 91", {"insee_fr"}),
        ("RSSMRA85T10A562S", {"cf_it"}),
        ("12345678Z", {"dni_es"}),
        ("34 ABC 1234", {"plate_tr"}),
        ("+1 (555) 123 4567", {"phone_us"}),
        ("+1 (555) 123-4567", set()),
        ("+90 532 123 45 67", {"phone_tr"}),
        ("+33 1 22 33 44 55", {"phone_fr"}),
        ("+44 1234 567890", {"phone_uk"}),
        ("+7 999 123 45 67", {"phone_ru"}),
        ("+49 123 1234567", {"phone_de"}),
        ("born 2024-01-02, 01/02/2024 or 01.02.2024", set()),
        ("", set()),
        ("1", set()),
        (None, set()),
    ],
)
def test_patterns(spark, text, kinds):
    assert {r.field_type for r in detect.by_patterns(blocks(spark, text)).collect()} == kinds


@pytest.mark.parametrize("text, found", [("Acme Ltd", True), ("Ltd", False), ("Many great ideas", True), ("Acme, AG", False), ("you can go with this for the sake of it Ltd", False), ("x" * 100 + " Ltd", False), ("Foo LTD. is here", True), ("Yıldız A.Ş.", True), ("air conditioning", False)])
def test_company_suffix(spark, text, found):
    assert one(spark, text, P.has_company_suffix) is found


def test_tokens_are_hmac(spark):
    key, message = "k" * 80, "é value"
    assert one(spark, message, lambda c: tokens.hmac_sha256(key, c)) == hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()
    assert re.fullmatch(r"PER-[0-9A-F]{8}", one(spark, message, lambda c: tokens.token(key, c, F.lit("PER"))))


@pytest.mark.parametrize("kind, ns", [("person_name", "PER"), ("company_name", "PER"), ("company", "ORG"), ("ip_address", "ADR"), ("tax_id", "IDN"), ("vat_no", "TAX"), ("invoice_number", "REF"), ("invoice", "INV"), ("plate_tr", "UNK"), ("nino_uk", "UNK"), ("stamp", "STP"), ("date_of_birth", "DAT"), (None, "UNK")])
def test_namespace(spark, kind, ns):
    assert one(spark, kind, tokens.namespace) == ns


@pytest.mark.parametrize("text, kind, key", [(None, "x", ""), ("John  SMITH", "person_name", "john smith"), ("John Smith.", "person_name", "john smith"), ("34-abc 12", "plate_tr", "34ABC12"), ("TEL: +90 532", "phone", "+90532"), ("Ｊｏｈｎ", "person_name", "john"), ("PLAKA: 34 A 1", "plate", "34A1"), ("r0b1n", "other", "robln"), ("12 01", "other", "12 01"), ("ŞÜKRÜ", "person_name", "sukru"), ("Adidas", "other", "das")])
def test_normalize(spark, text, kind, key):
    assert one(spark, text, lambda c: normalize(c, F.lit(kind))) == key


def test_dummies_keep_their_shape(spark):
    rows = [("34 Abc-123", "license_plate"), ("John Smith", "person_name"), ("Foo Bar Ltd.", "company_name"), ("a@b.co.uk", "email"), (" ", "stamp"), ("x", "stamp"), ("123-45-6789", "ssn_us"), ("12345", "other")]
    df = spark.createDataFrame(rows, "raw string, kind string").select("raw", dummy.replacement("k", F.col("raw"), F.col("kind")).alias("new"))
    out = {r.raw: r.new for r in df.collect()}
    assert out == {r.raw: r.new for r in df.collect()}
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", t)))
    assert shape(out["34 Abc-123"]) == "99 Aaa-999" and shape(out["123-45-6789"]) == "999-99-9999"
    assert len(out["John Smith"].split()) == 2 and out["Foo Bar Ltd."].endswith(" Ltd.") and out["a@b.co.uk"].endswith("@example.uk")
    assert out[" "] == " " and out["x"] == "[STAMP]" and out["12345"].isdigit()


@pytest.mark.parametrize("text, runs", [("34 ABC 123", [("D", 2), ("S", 1), ("L", 3), ("S", 1), ("D", 3)]), ("", []), ("AB12", [("L", 2), ("D", 2)]), ("é#", [("L", 1), ("X", 1)])])
def test_analyze(spark, text, runs):
    assert [tuple(r) for r in one(spark, text, dummy.analyze)] == runs


def test_boxes(spark):
    row = spark.range(1).select(*(geometry.overlap(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias(n) for n, a, b in (("same", (0, 0, 10, 10), (0, 0, 10, 10)), ("apart", (0, 0, 1, 1), (5, 5, 6, 6)), ("flat", (0, 0, 0, 5), (0, 0, 5, 5)), ("inside", (0, 0, 10, 10), (2, 2, 4, 4))))).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 1.0)


def make_fields(spark, rows):
    """rows: (src_ord, type, text, bbox, confidence)"""
    base = spark.createDataFrame([(1, 1, s, f"b{s}", k, t, t, b, c) for s, k, t, b, c in rows], "doc_id bigint, page int, src_ord bigint, block_id string, field_type string, text string, original_text string, bbox array<int>, confidence double")
    return detect.fields(base, **{c: c for c in base.columns}, detection_method=F.lit("pattern_match"))


def test_deduplicate(spark):
    f = make_fields(spark, [(1, "email", "a", [0, 0, 10, 10], 0.8), (2, "email", "a", [0, 0, 10, 10], 0.9), (3, "email", "b", None, None), (4, "email", "b", None, None), (5, "ssn", "a", [0, 0, 10, 10], 0.1)])
    assert {r.src_ord for r in ops.deduplicate(f).collect()} == {2, 3, 4, 5}
    assert ops.deduplicate(f.limit(0)).count() == 0


def test_triage(spark):
    got = ops.triage(make_fields(spark, [(1, "x", "a", None, 0.95), (2, "x", "a", None, 0.75), (3, "x", "a", None, 0.5), (4, "x", "a", None, None), (5, "x", "a", None, 0.75 + 0.1)])).collect()
    assert {r.src_ord: r.review_status for r in got} == {1: "auto_mask", 2: "needs_review", 5: "auto_mask"}


@pytest.mark.parametrize("answers, kept", [("YNYN", {1, 3}), ("NAYN", {2, 3, 4}), ("YSYY", {1}), ("", set())])
def test_review(spark, answers, kept):
    t = ops.triage(make_fields(spark, [(k, "x", "a", None, 0.7) for k in range(1, 5)]))
    d = spark.createDataFrame([(1, 1, k, a) for k, a in enumerate(answers, 1)], "doc_id bigint, page int, src_ord bigint, answer string")
    assert {r.src_ord for r in ops.review(t, d).collect()} == kept


@pytest.mark.parametrize("seed", range(3))
def test_leaders_are_those_of_one_pass(spark, seed):
    rng = random.Random(seed)
    words = ["ann", "bob", "carl", "dora", "evans", "fox", "12345678", "9012"]
    kinds = ["person_name", "company_name", "phone", "national_id", "email", "address"]
    rows, known = [], {}
    for k in range(150):
        key = "".join(rng.choice("0123456789") for _ in range(rng.choice([3, 8, 9]))) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(1, 4)))
        if key not in known:
            known[key] = rng.choice(kinds)
            rows.append((key, (k, 1, False, 0.0, 0), key, known[key], "m"))
    df = spark.createDataFrame(rows, "key string, ord struct<doc_id: bigint, page: int, is_review: boolean, rank: double, src_ord: bigint>, raw string, field_type string, detection_method string")
    assert {r.key: r.leader for r in canonical.leaders(df).collect()} == canonical.leaders_in_order(list(known.items()))


def test_similar_keys_of_the_query(spark):
    known = canonical.keys(registered._found(spark, FOLDER))
    order = [(r.key, r.field_type) for r in known.orderBy("ord").collect()]
    assert {r.key: r.leader for r in registered.queries()["canonical_similar"](spark, FOLDER).collect()} == canonical.leaders_in_order(order)


def test_responses(spark):
    raw = 'ok {"text_detections": [{"block_id": "block_1_0", "sensitive_value": "Jo", "label": "N: ", "category": "person_name", "confidence": 0.9}], "visual_detections": [{"type": "stamp"}]}'
    r = spark.createDataFrame([(1, 1, raw), (1, 2, "nothing"), (1, 3, None), (1, 4, '{"text_detections": [')], "doc_id bigint, page int, raw string")
    text = responses.text_fields(r, blocks(spark, "N: Jo")).collect()
    assert [(t.text, t.label, t.bbox) for t in text] == [("Jo", "N: ", [0, 0, 100, 16])]
    seen = responses.visual_fields(r).collect()
    assert [(v.text, v.bbox, v.confidence) for v in seen] == [("[STAMP]", None, 0.8)]


@pytest.mark.parametrize("mode, expected", [("block", "N: XX"), ("value", "N: XX and more")])
def test_mask(spark, mode, expected):
    f = make_fields(spark, [(0, "person_name", "Jo", [0, 0, 1, 1], 0.9)]).withColumn("block_id", F.lit("block_1_0")).withColumn("label", F.lit("N: ")).withColumn("replacement", F.lit("XX"))
    got = {r.block_id: (r.text, r.is_masked) for r in masking.mask(blocks(spark, "N: Jo and more", "other"), f, mode).collect()}
    assert got == {"block_1_0": (expected, True), "block_1_1": ("other", False)}


@pytest.mark.parametrize("text, status, score", [("all fine", "passed", 1.0), ("mail x@y.org", "warning", 0.35), ("john smith is here", "failed", 0.0), ("see PER-0123ABCD", "passed", 1.0)])
def test_verify(spark, text, status, score):
    b, f = blocks(spark, text), make_fields(spark, [(1, "person_name", "John Smith", None, 0.9), (2, "x", "date", None, 0.9), (3, "x", "is", None, 0.9)])
    row = ver.verify(b, ver.leaks(b, f)).first()
    assert (row.status, round(row.confidence_score, 6)) == (status, score)
    assert ver.verify(b, ver.leaks(b, f), enabled=False).first().status == "skipped"


def test_batch_summary_of_nothing(spark):
    f = make_fields(spark, []).withColumn("replacement", F.lit("x"))
    none = report.documents(f, f.groupBy("doc_id").agg(F.countDistinct("page").alias("total_pages")))
    row = report.batch_summary(none, report.failures(spark.createDataFrame([("d", None)], "document string, error string"))).first()
    assert (row.total_documents, row.successful, row.failed, row.fields_per_document) == (1, 0, 1, 0.0)


def test_whole_plan(spark, tmp_path):
    b = blocks(spark, "Contact: john@example.com", "john@example.com again", "Acme Widgets Ltd", "nothing here")
    result = Masker(Config(key="k")).run(b)
    texts = {r.block_id: r.text for r in result.masked.collect()}
    assert texts["block_1_0"] == texts["block_1_1"] and texts["block_1_0"].endswith("@example.com") and "john" not in texts["block_1_0"]
    assert texts["block_1_2"].endswith("Ltd") and "Acme" not in texts["block_1_2"] and texts["block_1_3"] == "nothing here"
    assert result.verification.first().status == "warning"  # new emails look like emails
    assert "original_text" not in result.reports.schema["masked_fields"].dataType.elementType.names
    store.save_registry(result.registry, str(tmp_path / "r"))
    again = Masker(Config(key="other")).run(b, known=store.load_registry(spark, str(tmp_path / "r")))
    assert {r.block_id: r.text for r in again.masked.collect()} == texts
    store.registry_json(result.registry, "now").write.text(str(tmp_path / "j"))
    assert store.read_registry_json(spark, str(tmp_path / "j")).count() == result.registry.count() == 2


def test_key_is_needed(spark):
    with pytest.raises(ValueError):
        Masker(Config()).run(blocks(spark, "a@b.co"))
    with pytest.raises(ValueError):
        Config(auto_mask=0.5, review_floor=0.6)


def test_files_and_images(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page1|page2")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"x")
    found = src.files(spark, str(tmp_path))
    assert {r.filename for r in found.collect()} == {"a.pdf", "b.pdf"}

    def renderer(content):
        if b"|" not in content:
            raise ValueError("not a document")
        return content.split(b"|")

    pages = src.render(found, renderer)
    assert sorted((r.page, r.error) for r in pages.collect()) == [(0, "not a document"), (1, None), (2, None)]
    read = src.read_images(pages, lambda c: [([[0, 0], [9, 0], [9, 5], [0, 5]], " " + c.decode(), 0.87654), ([[0, 0]], "x", 1)]).collect()
    assert sorted((r.block_id, r.text, r.bbox, r.confidence) for r in read) == [("block_1_0", "page1", [0, 0, 9, 5], 0.877), ("block_2_0", "page2", [0, 0, 9, 5], 0.877)]
    assert src.missing(spark.createDataFrame([("a.pdf",), ("z.pdf",)], "filename string"), found).first().error == "File not found: z.pdf"


def test_stream_registry(spark):
    found = detect.by_patterns(src.documents(spark, FOLDER)).unionByName(detect.by_company_suffix(src.documents(spark, FOLDER)))
    expected = {r.h for r in found.select(tokens.sha256(normalize(F.col("original_text"), F.col("field_type"))).alias("h")).distinct().collect()}
    got = [r.normalized_hash for r in registered.stream_registry(spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_sources_skip_nulls(spark):
    t = spark.createDataFrame([(1, "a\n bc \n\nde", "x"), (None, "text", "x"), (2, None, None), (3, "", None), (1, "a\n bc ", "x")], "doc_id bigint, text string, page string")
    assert sorted(r.text for r in src.from_lines(t).collect()) == ["bc", "bc", "de"]
    assert src.from_lines(t.limit(0)).count() == 0


def test_nfkc_is_that_of_python(spark):
    text = "ﬁ①Å ½"
    assert one(spark, text, lambda c: normalize(c, F.lit("email"))) == unicodedata.normalize("NFKC", text).lower()


def test_merge(spark):
    schema = store.REGISTRY
    old = spark.createDataFrame([("h1", "t1", "PER", 1, "c", 1.0)], schema)
    new = spark.createDataFrame([("h1", "t2", "PER", 2, "c", 1.0), ("h2", "t3", "PER", 2, "c", 1.0)], schema)
    assert {r.normalized_hash: r.token for r in rep.merge(old, new).collect()} == {"h1": "t1", "h2": "t3"}


def test_durations_round_their_seconds(spark):
    from maskwright.functions.text import duration

    rows = [(3.24,), (59.96,), (60.5,), (61.5,), (125.7,), (119.7,), (3600.0,), (3725.4,), (7325.6,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(duration(F.col("x"))).collect()]
    assert got == ["3.2s", "60.0s", "1m 0s", "1m 2s", "2m 6s", "1m 60s", "1h 0m 0s", "1h 2m 5s", "2h 2m 6s"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_runs_once_and_only_what_is_asked(spark):
    """Expressions of the patterns that are named alone, each once; registries from one scan."""
    from maskwright.plans import queries as registered

    assert _plan(registered.flagship(spark, FOLDER)).count("regexp_extract(") <= 2
    one = _plan(detect.by_patterns(src.documents(spark, FOLDER), ("email",)))
    assert one.count("regexp_extract(") == 1
    for name in ("canonical_exact", "registry_first_seen", "registry_merge"):
        assert _plan(registered.queries()[name](spark, FOLDER)).count("FileScan parquet") <= 2


def test_command_line(spark, tmp_path):
    """Fields that need review are masked without answers, and as answered with them."""
    from maskwright import cli

    docs = spark.createDataFrame([(1, "Mail jane.roe@example.com or 192.168.10.20 now\nCall +90 532 123 45 67 today")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/in")
    run = lambda *a: cli.main([f"{tmp_path}/in", "-o", f"{tmp_path}/out", "--key", "k", "-q", *a])
    text = lambda: " ".join(r.text for r in spark.read.parquet(f"{tmp_path}/out/masked").collect())
    run("--no-review")
    bare = text()
    run()
    assert text() == bare and "jane.roe@example.com" not in bare
    queue = spark.read.parquet(f"{tmp_path}/out/review")
    queue.select("doc_id", "page", "src_ord", F.lit("N").alias("answer")).write.parquet(f"{tmp_path}/answers")
    n = queue.count()
    run("--decisions", f"{tmp_path}/answers")
    assert n and text() != bare


def _exchanges(df):
    """What lies below each exchange of the plan, the outermost first."""
    return re.split(r"Exchange \w+", _plan(df))[1:]


def test_statistics_shuffle_a_row_a_field(spark):
    """Fields are spread over the countings after their only shuffle; nulls and empty lists count as elsewhere."""
    rows = [(1, 1, "email", "LOW", ["A", "B"]), (1, 1, "email", None, None), (1, None, None, "LOW", []), (1, 2, "email", "LOW", ["A", None]), (2, 1, "x", "all", ["A"]), (None, 1, "x", "LOW", ["A"])]
    f = spark.createDataFrame(rows, "doc_id bigint, page int, field_type string, risk_level string, regulations array<string>")
    got = report.statistics(f)
    want = {}
    for doc, page, kind, risk, rules in rows:
        for pair in [("total", "all"), ("type", kind or "unknown"), ("page", str(page or 0)), ("risk_level", risk or "UNKNOWN"), *(("regulation", r) for r in rules or [])]:
            want[doc, *pair] = want.get((doc, *pair), 0) + 1
    assert {tuple(r)[:3]: r.n for r in got.collect()} == want
    below = _exchanges(registered.queries()["stats_grouping_sets"](spark, FOLDER))
    assert len(below) == 1 and "Generate" not in below[0]


def test_fields_meet_as_they_are(spark):
    """Fields are compared after their only shuffle, as one after the other in plain Python would be; all their columns come through."""
    rng = random.Random(5)
    rows = [(d, rng.choice([1, 2, None]), k, rng.choice(["b0", "b1", None]), rng.choice(["x", "y"]), rng.choice([" Same ", "same", "other", None]), rng.choice([None, [0, 0, 10, 10], [2, 0, 12, 10], [8, 8, 20, 20]]), rng.choice([None, 0.5, 0.9])) for d in range(12) for k in range(12)]
    f = spark.createDataFrame(rows, "doc_id bigint, page int, src_ord bigint, block_id string, field_type string, text string, bbox array<int>, confidence double").withColumn("label", F.concat_ws("-", "doc_id", "src_ord"))

    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return max(w, 0) * max(h, 0) / min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))

    kept = []
    for r in sorted(rows, key=lambda r: (-(r[7] or 0), r[2])):
        same = lambda o: (o[3] == r[3] and (o[5] or "").strip().lower() == (r[5] or "").strip().lower()) or (o[6] and r[6] and share(o[6], r[6]) > 0.7)  # noqa: B023, E731
        if not any(same(o) for o in kept if (o[0], o[1], o[4]) == (r[0], r[1], r[4])):
            kept.append(r)
    got = ops.deduplicate(f)
    assert got.columns == f.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*r, f"{r[0]}-{r[2]}")) for r in kept)
    below = _exchanges(registered.queries()["dedup_nms"](spark, FOLDER))
    assert len(below) == 1 and "Aggregate" not in below[0]


def test_leaks_are_those_of_whole_pages(spark, tmp_path):
    """Leaks of patterns are found in blocks as in the page's joined text; the masked blocks are looked through once for both kinds."""
    rng = random.Random(3)
    bits = ["jane@x.example.com", "123-45-6789", "+12345678", "123", "45-6789", "@", "PER-0123ABCD", "user@", "b.co", "é@b.co", "Secret Name", "XXXX@b.co", "١٢٣-٤٥-٦٧٨٩"]
    rows = [(d, p, k, f"block_{p}_{k}", None if rng.random() < 0.1 else rng.choice(["", " "]).join(rng.choices(bits, k=rng.randint(1, 4))), [0, k, 9, k + 1], 0.9) for d in range(8) for p in (1, 2) for k in range(6)]
    b = spark.createDataFrame(rows, src.SCHEMA)
    pages = {}
    for d, p, k, _, t, *_ in rows:
        pages.setdefault((d, p), []).append((k, t or ""))
    forms = {"email": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "ssn": r"\d{3}-\d\d-\d{4}", "phone": r"\+?[1-9]\d{6,14}"}
    want = sorted((d, p, kind, m) for (d, p), ts in pages.items() for kind, rx in forms.items() for m in re.findall(rx, " ".join(t for _, t in ts)) if len(m) >= 4 and not re.search(P.MASKED, m))
    assert want and sorted(map(tuple, ver.pattern_leaks(b).collect())) == want
    f = detect.fields(b, doc_id="doc_id", page="page", original_text=F.lit("secret name")).filter("doc_id % 2 = 0")
    old = sorted((d, p, "original_text_leaked", "secret name", [0, min(k for k, t in ts if "secret name" in t.lower()), 9]) for (d, p), ts in pages.items() if d % 2 == 0 and any("secret name" in t.lower() for _, t in ts))
    got = ver.leaks(b, f)
    rows = [(r.doc_id, r.page, r.field_type, r.text, r.bbox and r.bbox[:3], r.confidence, r.detection_method) for r in got.collect()]
    assert old and sorted(r[:5] for r in rows if r[2] == "original_text_leaked") == old
    assert sorted(r[:4] for r in rows if r[2] != "original_text_leaked") == want
    assert {r[2:3] + r[5:] for r in rows} <= {("original_text_leaked", 0.95, "original_text_match")} | {(k, 0.7, "pattern_match") for k in forms}
    assert all(r[4] is None for r in rows if r[2] != "original_text_leaked")
    b.write.parquet(f"{tmp_path}/b")
    assert _plan(ver.leaks(spark.read.parquet(f"{tmp_path}/b"), f)).count("FileScan parquet") == 1


def test_company_suffix_is_that_of_the_reference(spark):
    """The cheap questions put first leave out nothing."""
    rng = random.Random(11)
    bits = ["Acme", "Ltd", "Ltd.", "GmbH & Co. KG", "as", "ideas", "İnşaat", "Yapı A.Ş.", "ltd. şti.", "the", "and", "ß", " ", " ", "7", "INC,", "spa", "x" * 40, "&", "ﬀ"]
    texts = ["".join(w + rng.choice([" ", " ", "", "  ", "\t"]) for w in rng.choices(bits, k=rng.randint(1, 9))) for _ in range(1500)] + ["ß" * 48 + " Ltd", "ß" * 49 + " Ltd", " " * 80 + "Acme Ltd" + " " * 60, " Ltd", ""]

    def plain(text):
        up = text.upper().strip()
        if len(up) > 100 or sum(f" {w} " in text.lower() for w in P.SENTENCE) >= 2:
            return False
        return any((up.endswith(s) and re.search(rf"(?s)^.+\S\s*{re.escape(s)}\Z", up)) or re.search(rf"\b[A-Z][A-Z0-9&\s]+\s{re.escape(s)}(?:[.,]|\s|\Z)", up) for s in P.SUFFIXES)

    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    got = {r.k: r.has for r in df.select("k", P.has_company_suffix(F.col("x")).alias("has")).collect()}
    assert [texts[k] for k in got if bool(got[k]) != bool(plain(texts[k]))] == []
    assert 0.1 < sum(map(bool, got.values())) / len(texts) < 0.9
