"""Detectors on small texts: each rule has hits and near misses."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden import fixed_values as V
from sparkwarden.functions import redact, text as tx
from sparkwarden.functions.regex import expand
from sparkwarden.operators import images, keywords, logs, names
from sparkwarden.operators.lines import document_lines, line_findings, scan_lines, text_findings
from sparkwarden.operators.rules import LINE_RULES, PII_RULES, SECRET_RULES

HEX = "0123456789abcdef"
KEY = "AI" + "zaSy" + "Fake" * 9

PLANTED = {
    "g1": (KEY, ["google-api-key"]),
    "g2": ("AI" + "zaShort", []),
    "aws1": ("id AK" + "IAABCDEFGHIJKLMNOP ok", ["aws-access-key"]),
    "aws2": ("AK" + "IATESTKEY12345678", []),
    "aws3": ("AWS_SECRET_ACCESS_KEY=" + "abcdefghijklmnopqrstuvwxyz0123456789ABCD",
             ["aws-secret-key", "env-secret-value"]),
    "pk": ("-----BEGIN " + "RSA PRIVATE" + " KEY-----", ["private-key-block"]),
    "pub": ("-----BEGIN PUBLIC KEY-----", []),
    "env": ("API_KEY=s" + "k-test1234567890abcdef1234567890", ["env-secret-value", "openai-key"]),
    "jwt": ("JWT_SECRET=supersecretjwtkey1234567890", ["env-secret-value"]),
    "db": ("DATABASE_URL=postgres://user:" + "secretpassword123@localhost:5432/mydb", ["database-url"]),
    "db2": ("postgres://localhost:5432/mydb", []),
    "dw": ("https://discord.com/api/web" + "hooks/123456/abc-DEF_1", ["discord-webhook"]),
    "gh": ("gh" + "p_" + "a1B2" * 9, ["github-token"]),
    "ant": ("s" + "k-ant-" + "x9" * 12, ["anthropic-key"]),
    "az": ("Account" + "Key=" + "A" * 86 + "==", ["azure-key"]),
    "gcp": ('{ "type": "service_account" }', ["gcp-service-account"]),
    "br": ("Authorization: Bea" + "rer abcdefghijklmnopqrstuvwxyz", ["bearer-token"]),
    "ent": ('token = "' + HEX * 2 + 'abcdef01"', ["high-entropy-string"]),
    "ent0": ('token = "' + "a" * 40 + '"', []),
    "em": ("write to mira.holt@north-post.co.uk, not to x@example.com", ["email-address"]),
    "v": ("a@1.2.3.com", []),
    "more": ("a@example.community b@mail6.example.com", ["email-address"]),
    "uk": ("ring 0161 496 0321 after six.", ["uk-phone"]),
    "uk2": ("+44 7700 900461", []),
    "us": ("(212) 555-0100", ["us-phone"]),
    "pc": ("from EH8 9YL to B12QP", ["uk-postcode", "uk-postcode"]),
    "di": ("see discord.gg/AbC123 or DISCORD.GG/x", ["discord-handle", "discord-handle"]),
    "du": ("mira_h#4821", ["discord-username"]),
    "ip": ("127.0.0.1 10.0.0.7 255.255.255.255", ["ipv4-address"]),
    "both": ("0123456789", ["uk-phone", "us-phone"]),
    "fr": ("é0123456789", ["uk-phone", "us-phone"]),
    "nb": ("0161 496 0321", ["uk-phone"]),
    "none": ("const total = items.length; // nothing to see", []),
}


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(k, text) for k, (text, _) in PLANTED.items()]
    return spark.createDataFrame(rows, "id string, text string")


@pytest.fixture(scope="module")
def found(planted):
    return line_findings(planted, ["id"], LINE_RULES).collect()


@pytest.mark.parametrize("key", list(PLANTED))
def test_each_rule_hits_what_it_should(found, key):
    assert sorted(r.rule for r in found if r.id == key) == sorted(PLANTED[key][1])


def test_every_rule_has_a_hit(found):
    assert {r.rule for r in found} == {r.name for r in LINE_RULES}


def test_gates_lose_nothing(planted, spark):
    """Brute force: every pattern on every line, without gates."""
    expected = set()
    for r in LINE_RULES:
        rows = planted.select(
            "id", F.posexplode(F.regexp_extract_all("text", F.lit(expand(r.pattern)), F.lit(r.group))).alias("n", "m")
        ).collect()
        expected |= {(x.id, r.ord, x.n, x.m) for x in rows}
    ours = scan_lines(planted, ["id"], LINE_RULES, drop_false_positives=False).collect()
    assert {(x.id, x.rule_ord, x.match_ord, x.match) for x in ours} == expected


def test_redaction_shapes(found):
    evidence = {(r.id, r.rule): r.redacted_evidence for r in found}
    assert evidence["g1", "google-api-key"] == "AIzaSy...Fake"
    assert evidence["em", "email-address"] == "mi***@north-post.co.uk"
    assert evidence["uk", "uk-phone"] == "0161...21"
    assert evidence["pc", "uk-postcode"] in ("EH***YL", "B1***QP")
    assert evidence["du", "discord-username"] == "mir***821"
    assert evidence["ip", "ipv4-address"] == "10.0.0.7"


def test_no_evidence_holds_a_secret(planted):
    secrets = {(r.id, r.match) for r in scan_lines(planted, ["id"], SECRET_RULES).collect()}
    shown = line_findings(planted, ["id"], SECRET_RULES).collect()
    for key, secret in secrets:
        assert all(secret not in r.redacted_evidence for r in shown if r.id == key)


def test_short_secret_is_hidden(spark):
    row = spark.range(1).select(redact.secret(F.lit("0123456789")).alias("a"), redact.secret(F.lit("0123456789x")).alias("b"))
    assert tuple(row.first()) == ("...", "012345...789x")


def test_severities(found):
    severity = {r.rule: r.severity for r in found}
    assert severity["google-api-key"] == "high" and severity["private-key-block"] == "critical"
    assert severity["database-url"] == "critical" and severity["env-secret-value"] == "high"
    assert severity["email-address"] == "medium" and severity["ipv4-address"] == "low"


def test_lines(spark):
    df = spark.createDataFrame([(1, ""), (2, "a\n"), (3, "a\r\nb\n\n")], "id int, text string")
    got = [tuple(r) for r in document_lines(df, ["id"]).orderBy("id", "line").collect()]
    assert got == [(1, 1, ""), (2, 1, "a"), (2, 2, ""), (3, 1, "a\r"), (3, 2, "b"), (3, 3, ""), (3, 4, "")]


def test_blank_does_not_cross_lines(spark):
    df = spark.createDataFrame([(1, "0161 496\n0321")], "id int, text string")
    assert line_findings(df, ["id"], PII_RULES).count() == 0


def test_entropy(spark):
    df = spark.createDataFrame([("abcdefgh",), ("aaaa",), ("aabb",)], "s string")
    assert [r[0] for r in df.select(redact.entropy(F.col("s"))).collect()] == [3.0, 0.0, 1.0]


# ---------------------------------------------------------------- names
NAMES = {
    ".env": ["env-file"], ".env.local": ["env-file"], "a/b/.ENV": ["env-file"], "x.env": [],
    "credentials.json": ["credentials-file", "suspicious-filename"], "id_rsa": ["ssh-private-key"],
    "cert.pem": ["pem-file"], "x.pem\n": [], "service-account-prod.json": ["service-account-json"],
    "config\\secrets.yml": ["secrets-file"], "chat_export_chat.txt": ["chat-export", "chat-export"],
    "img_photo.txt": ["photo-file", "photo-file"], "logs/app.log": ["log-file"], "passwords.txt": ["suspicious-filename"],
    "normal-code.ts": [], "dir.pem/": [], "invoice.md": ["suspicious-filename"],
}


def test_names(spark):
    df = spark.createDataFrame([(p,) for p in NAMES], "path string")
    found = names.suspicious_names(df, ["path"]).unionByName(names.risk_names(df, ["path"])).collect()
    assert {p: sorted(r.rule for r in found if r.path == p) for p in NAMES} == {p: sorted(v) for p, v in NAMES.items()}


def test_image_and_text_suffixes(spark):
    df = spark.createDataFrame([("photo.jpg",), ("p.JPEG",), ("a.tif",), ("code.ts",), ("Makefile",)], "path string")
    got = df.select(tx.is_image(F.col("path")), tx.is_scannable(F.col("path")), tx.is_scannable(F.col("path"), True))
    assert [tuple(r) for r in got.collect()] == [
        (True, True, False), (True, True, False), (True, True, False), (False, True, True), (False, True, False)]


# ---------------------------------------------------------------- logs
def _log(n, total):
    return "\n".join(["ERROR went wrong"] * n + ["all is well"] * (total - n))


@pytest.mark.parametrize("text,flagged", [
    (_log(100, 100), False), (_log(101, 101), True), (_log(150, 150), True), (_log(45, 150), False),
    (_log(46, 150), True), ("\n".join(["ERROR"] * 150), False),
    ("\n".join(f"2024-06-15T10:30:{i % 60:02d}Z ERROR line {i}" for i in range(150)), True),
])
def test_large_logs(spark, text, flagged):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert logs.large_logs(df, ["id"]).count() == int(flagged)
    assert logs.log_findings(df, ["id"]).count() == int(flagged)
    whole = text_findings(df, ["id"], LINE_RULES).where("rule = 'large-log-file'")
    assert whole.count() == int(flagged)


def test_one_pass_equals_single_detectors(planted):
    whole = text_findings(planted, ["id"], LINE_RULES)
    assert whole.where("rule is null").count() == len(PLANTED)
    columns = ["id", "line", "rule", "severity", "redacted_evidence", "scanner_ord", "rule_ord", "match_ord"]
    lines = line_findings(planted, ["id"], LINE_RULES).select(columns).collect()
    assert sorted(whole.where("rule is not null").select(columns).collect()) == sorted(lines)


# ---------------------------------------------------------------- keywords
def test_keywords(spark):
    accounts = spark.createDataFrame(
        [("a", ["token", "the", ""]), ("b", ["2.0.", "a|b", "café"]), ("c", [""]), ("d", None)],
        "account_id string, keywords array<string>")
    patterns = keywords.keyword_patterns(accounts)
    assert {r.account_id: r.pattern for r in patterns.collect()} == {"a": "token|the", "b": r"2\.0\.|a\|b|café"}
    texts = spark.createDataFrame(
        [("a", "The TOKEN the the\nother"), ("b", "v2.0. 2x0. A|B CAFÉ"), ("c", "the"), ("d", "the")],
        "account_id string, text string").join(patterns, "account_id")
    found = keywords.keyword_findings(texts, ["account_id"]).orderBy("account_id", "line", "match_ord").collect()
    assert [(r.account_id, r.line, r.redacted_evidence, r.severity) for r in found] == [
        ("a", 1, 'Keyword match: "The"', "low"), ("a", 1, 'Keyword match: "TOKEN"', "medium"),
        ("a", 2, 'Keyword match: "the"', "low"), ("b", 1, 'Keyword match: "2.0."', "low"),
        ("b", 1, 'Keyword match: "A|B"', "low"), ("b", 1, 'Keyword match: "CAFÉ"', "low")]
    assert keywords.keyword_matches(texts, ["account_id"]).where("account_id = 'a'").count() == 5


# ---------------------------------------------------------------- image records
GPS = json.dumps([{"SourceFile": "x.jpg", "GPSLatitude": 46.9481, "GPSLongitude": 7.4474, "Model": "Boxy 300",
                   "Software": "17.0.1", "DateTimeOriginal": "2021:11:02 07:45:10", "OwnerName": "Mira Holt",
                   "SerialNumber": "KX77-00419-Q2"}])
EMPTY = json.dumps([{k: None for k in ("GPSLatitude", "GPSLongitude", "Model", "OwnerName", "SerialNumber")}])


def test_image_records(spark):
    df = spark.createDataFrame(
        [("gps", GPS), ("none", EMPTY), ("bad", "not json"), ("nothing", "[]"), ("object", '{"Model":"x"}'),
         ("serial", '[{"SerialNumber":"","InternalSerialNumber":"I9"}]'), ("short", '[{"SerialNumber":"A123"}]'),
         ("zero", '[{"GPSLatitude":0,"GPSLongitude":0,"Model":0}]'), ("create", '[{"CreateDate":"2024"}]'),
         ("texts", '[{"SerialNumber":"0","OwnerName":"false"}]'), ("junk", '[{"Model":"Cam"}] junk'),
         ("falsy", '[{"SerialNumber":0.0,"OwnerName":-0,"Model":false,"Software":2.50}]'),
         ("closed", '[{"Model":"Cam"}]] junk'), ("second", '[{"Model":"Cam"}], [1]')],
        "id string, meta_json string")
    parsed = {r.id: r for r in images.parse_metadata(df, ["id"]).collect()}
    gps = parsed["gps"]
    assert gps.has_gps and gps.camera_model == "Boxy 300" and gps.owner_name == "Mira Holt"
    assert gps.device_serial == "KX77-00419-Q2" and gps.gps_lat == "46.9481"
    for key in ("none", "bad", "nothing", "object"):
        assert not parsed[key].has_gps and parsed[key].camera_model is None
    assert parsed["serial"].device_serial is None
    assert parsed["zero"].has_gps and parsed["zero"].camera_model is None
    assert parsed["create"].taken_at == "2024"
    assert parsed["texts"].device_serial == "0" and parsed["texts"].owner_name == "false"
    assert parsed["falsy"].device_serial is None and parsed["falsy"].owner_name is None
    assert parsed["falsy"].camera_model is None and parsed["falsy"].software == "2.5"
    for key in ("junk", "closed", "second"):
        assert parsed[key].camera_model is None

    table = images.parse_metadata(df, ["id"])
    hidden = {(r.id, r.rule): r for r in images.image_findings(table, ["id"]).collect()}
    assert "46.9481" not in hidden["gps", "gps-metadata"].redacted_evidence
    assert hidden["gps", "gps-metadata"].metadata["cameraModel"] == "Boxy 300"
    assert hidden["gps", "device-serial"].redacted_evidence == "Device serial: KX...Q2"
    assert hidden["short", "device-serial"].redacted_evidence == "Device serial: ..."
    assert sum(1 for k in hidden if k[0] == "gps") == 5 and ("none", "gps-metadata") not in hidden
    shown = {(r.id, r.rule): r for r in images.image_findings(table, ["id"], True).collect()}
    assert shown["gps", "gps-metadata"].redacted_evidence == "GPS: 46.9481, 7.4474"
    assert shown["gps", "gps-metadata"].metadata["gpsLat"] == "46.9481"


def test_every_rule_has_an_action(spark):
    rules = {r.name for r in LINE_RULES} | {p[0] for p in V.SENSITIVE_NAME_PATTERNS + V.PICTURE_NAME_PATTERNS}
    rules |= {p[0] for p in V.LOG_NAME_PATTERNS} | {r for r, _ in V.EXIF_RULES}
    assert rules <= set(V.ACTIONS)
    df = spark.createDataFrame([("pem-file",), ("unheard-of",)], "rule string")
    assert all(r[0] for r in df.select(tx.action_for(F.col("rule"))).collect())
