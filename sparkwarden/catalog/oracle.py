"""DuckDB statements that answer the named queries on the same tables, written independently of the
DataFrame code: joins over every tree entry, one branch per rule, plain regular expressions."""

from __future__ import annotations

from .. import fixed_values as V
from ..functions.regex import expand
from ..plans.report import FIX_LIST_CLOSING, FIX_LIST_OPENING, NO_SUMMARY
from .inputs import with_inputs

SEEN_AT = "2024-06-01T06:00:00Z"
FINISHED_AT = "2024-06-01T06:00:00.000Z"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return q(expand(pattern, boundary=r"\b"))


def case(key: str, values: dict, default: str = "null") -> str:
    branches = " ".join(f"when {q(k)} then {q(v)}" for k, v in values.items())
    return f"(case {key} {branches} else {default} end)"


def statement(inputs: list[str], ctes: list[tuple[str, str]], select: str) -> str:
    parts = [p for p in [with_inputs(inputs)] if p]
    parts += [f"{name} as ({body})" for name, body in dict(ctes).items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + select


# ---------------------------------------------------------------- lines and rules
PII = [(i + len(V.SECRET_PATTERNS), n, s, p, 0) for i, (n, s, p) in enumerate(V.PII_PATTERNS)]
SECRETS = [(i, n, s, p, g) for i, (n, s, p, g) in enumerate(V.SECRET_PATTERNS)]


def lines_cte(source: str, keys: str, text: str = "text") -> tuple[str, str]:
    return (
        "lines",
        f"select {keys}, unnest(string_split({text}, chr(10))) l, "
        f"generate_subscripts(string_split({text}, chr(10)), 1) line from {source}",
    )


def found_cte(rules, keys: str) -> tuple[str, str]:
    branches = [
        f"select {keys}, line, {i} rule_ord, {q(n)} rule, {q(s)} severity, "
        f"unnest(regexp_extract_all(l, {re2(p)}, {g})) m, "
        f"generate_subscripts(regexp_extract_all(l, {re2(p)}, {g}), 1) - 1 match_ord "
        f"from lines where regexp_matches(l, {re2(p)})"
        for i, n, s, p, g in rules
    ]
    return "found", "\nunion all ".join(branches)


ENTROPY = "round((select entropy(c) from (select unnest(string_split({0}, '')) c)), 6)"
FALSE_POSITIVE = (
    "(contains(m, '@example.com') or contains(m, '@test.com') or contains(m, '@localhost') "
    r"or (contains(m, '@') and regexp_matches(m, '\d+\.\d+\.\d+')) "
    "or m in ('127.0.0.1', '0.0.0.0', '255.255.255.255'))"
)
FIRST_PII = len(V.SECRET_PATTERNS)
KEPT = f"""select f.* from found f where not (
    (rule_ord >= {FIRST_PII} and {FALSE_POSITIVE})
    or (rule = 'openai-key' and m like 'sk-ant-%'))
    and (rule <> 'high-entropy-string' or {ENTROPY.format('m')} >= 3.0)"""
REDACTED = """(case when rule = 'email-address'
    then concat(left(split_part(m, '@', 1), 2), '***@', split_part(m, '@', 2))
    when rule in ('uk-phone', 'us-phone') then concat(left(m, 4), '...', right(m, 2))
    when rule = 'uk-postcode' then concat(left(m, 2), '***', right(m, 2))
    when rule = 'discord-username' then concat(left(m, 3), '***', right(m, 3))
    when rule in ('discord-handle', 'ipv4-address') then m
    when length(m) <= 10 then '...' else concat(left(m, 6), '...', right(m, 4)) end)"""


def matches(rules, source: str, keys: str, text: str = "text") -> list[tuple[str, str]]:
    return [lines_cte(source, keys, text), found_cte(rules, keys), ("kept", KEPT)]


def rule_sql(name: str) -> str:
    rules = [r for r in SECRETS + PII if r[1] == name]
    return statement(
        ["doc_files"], matches(rules, "doc_files", "doc_id"),
        f"select doc_id, line, match_ord, m as match, {REDACTED} redacted_evidence from kept",
    )


# ---------------------------------------------------------------- names, logs, keywords, images
BASE = "list_last(string_split(replace(path, '\\', '/'), '/'))"
SUSPICIOUS = f"regexp_matches({BASE}, {q('(?i)' + '|'.join(V.SUSPICIOUS_NAME_WORDS))})"


def names_sql(source: str, keys: str, suspicious: bool, risks: bool) -> str:
    out = []
    if suspicious:
        out.append(
            f"select {keys}, 'suspicious-filename' rule, 'low' severity, "
            f"concat('Filename may contain personal data: ', {BASE}) redacted_evidence, 2 scanner_ord, "
            f"0 rule_ord from {source} where {SUSPICIOUS}"
        )
    if risks:
        groups = [("Sensitive file: ", V.SENSITIVE_NAME_PATTERNS),
                  ("Screenshot/photo file: ", V.PICTURE_NAME_PATTERNS),
                  ("Log/chat export file: ", V.LOG_NAME_PATTERNS)]
        flat = [(prefix, *p) for prefix, patterns in groups for p in patterns]
        for i, (prefix, rule, severity, pattern) in enumerate(flat):
            out.append(
                f"select {keys}, {q(rule)}, {q(severity)}, concat({q(prefix)}, {BASE}), 3, {i} "
                f"from {source} where regexp_matches({BASE}, {re2(pattern)})"
            )
    if not suspicious:
        out[0] = out[0].replace(f"{q(flat[0][1])}, {q(flat[0][2])}, concat",
                                f"{q(flat[0][1])} rule, {q(flat[0][2])} severity, concat")
        out[0] = out[0].replace(", 3, 0 from", " redacted_evidence, 3 scanner_ord, 0 rule_ord from")
    return "\nunion all ".join(out)


def log_counts(source: str, key: str) -> list[tuple[str, str]]:
    return [
        lines_cte(source, key),
        ("log_counts", f"select {key}, count(*) n_lines, "
                       f"count(*) filter (where regexp_matches(l, {re2(V.LOG_LINE_PATTERN)})) n_log_lines "
                       f"from lines group by {key}"),
    ]


LARGE = "n_lines > 100 and n_log_lines > 0.3 * n_lines"
LOG_EVIDENCE = "concat('Large log-like file (', n_lines, ' lines, ', n_log_lines, ' log-pattern lines)')"

ACCOUNTS = ("accounts", "select account_id, account_ord, \"user\", coalesce(enabled, true) enabled, contact_email, "
                        "cc_email, string_split(keyword_list, ',') keywords from raw_accounts")
PATTERNS = ("patterns", r"select account_id, array_to_string(list_transform(keywords, "
                        r"lambda k: regexp_replace(k, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')), '|') pattern "
                        "from accounts where keywords is not null")
RISKY = "(" + " or ".join(f"contains(lower(m), {q(w)})" for w in V.HIGH_RISK_KEYWORD_WORDS) + ")"
KEYWORD_SEVERITY = f"(case when {RISKY} then 'medium' else 'low' end)"


def keyword_ctes(source: str, keys: str) -> list[tuple[str, str]]:
    return [
        ACCOUNTS, PATTERNS,
        ("keyword_lines", f"select {keys}, pattern, unnest(string_split(text, chr(10))) l, "
                          f"generate_subscripts(string_split(text, chr(10)), 1) line "
                          f"from {source} join patterns using (account_id)"),
        ("keyword_found", f"select {keys}, line, unnest(regexp_extract_all(l, concat('(?i)', pattern))) m, "
                          "generate_subscripts(regexp_extract_all(l, concat('(?i)', pattern)), 1) - 1 match_ord "
                          "from keyword_lines"),
    ]


def keyword_first(keys: str) -> tuple[str, str]:
    return ("keyword_first", f"select {keys}, line, m, match_ord from keyword_found qualify row_number() over "
                             f"(partition by {keys}, line, lower(m) order by match_ord) = 1")


def json(name: str) -> str:
    return f"(case when json_valid(meta_json) then json_extract_string(meta_json, '$[0].{name}') end)"


def filled(*names: str) -> str:
    """The first field that is not null, unless it is an empty text, a number equal to 0 or false."""
    branches = ""
    for name in names:
        kind = f"(case when json_valid(meta_json) then json_type(meta_json, '$[0].{name}') end)"
        branches += (
            f" when {kind} = 'VARCHAR' then nullif({json(name)}, '') when {kind} = 'BOOLEAN' then nullif({json(name)}, 'false')"
            f" when {kind} <> 'NULL' then case when try_cast({json(name)} as double) <> 0 then {json(name)} end"
        )
    return f"(case{branches} end)"


def images_cte(source: str, key: str) -> tuple[str, str]:
    lat, lng = json("GPSLatitude"), json("GPSLongitude")
    has = f"({lat} is not null and {lng} is not null)"
    return ("images", f"""select {key}, {has} has_gps,
        case when {has} then {lat} end gps_lat, case when {has} then {lng} end gps_lng,
        {filled('SerialNumber', 'InternalSerialNumber')} device_serial,
        {filled('OwnerName')} owner_name, {filled('Model')} camera_model, {filled('Software')} software,
        {filled('DateTimeOriginal', 'CreateDate')} taken_at from {source}""")


def image_findings(key: str, exact: bool) -> str:
    evidence = ("concat('GPS: ', gps_lat, ', ', gps_lng)" if exact
                else "'GPS metadata present (coordinates redacted)'")
    where = ("concat('gpsLat=', gps_lat, ', gpsLng=', gps_lng)" if exact
             else "'gps=GPS coordinates present (redacted by default)'")
    camera = "case when camera_model is null then '' else concat(', cameraModel=', camera_model) end"
    return f"""select {key}, 'gps-metadata' rule, 'high' severity, {evidence} redacted_evidence,
        concat({where}, {camera}) metadata, 0 rule_ord from images where has_gps
      union all select {key}, 'device-serial', 'medium', concat('Device serial: ', case when length(device_serial) <= 4
        then '...' else concat(left(device_serial, 2), '...', right(device_serial, 2)) end), null, 1
        from images where device_serial is not null
      union all select {key}, 'owner-name', 'medium', concat('Owner name: ', owner_name), null, 2
        from images where owner_name is not null
      union all select {key}, 'camera-model', 'low', concat('Camera model: ', camera_model), null, 3
        from images where camera_model is not null
      union all select {key}, 'software-metadata', 'low', concat('Software: ', software), null, 4
        from images where software is not null"""


ACTION = case("rule", V.ACTIONS)

# ---------------------------------------------------------------- the scan, file by file
IS_IMAGE = r"regexp_matches(lower(path), '\.(jpe?g|png|webp|heic|tiff?)$')"
TREE = ("tree", "select commit_sha, blob_sha, path, coalesce(size, 0) size from raw_tree where type = 'blob'")
ENABLED = ("scanned", "select * from accounts where enabled")
ONE = ("scanned", "select * from accounts where account_id = 'acct_4'")
KEY = "blob_sha"


def scan_ctes(selected: tuple[str, str]) -> list[tuple[str, str]]:
    file = "account_id, account_ord, repo, repo_ord, commit_sha, commit_ord, path"
    return [
        ACCOUNTS, selected, PATTERNS, TREE,
        ("chosen", "select account_id, account_ord, repo, repo_ord from repos join scanned using (account_id) "
                   "where not fork and not archived"),
        ("scanned_commits", "select c.commit_sha, c.commit_ord, r.* from commits c join chosen r on c.repo = r.repo"),
        ("files", f"select {file}, blob_sha, case when {IS_IMAGE} then 'image' else 'text' end route "
                  "from tree join scanned_commits using (commit_sha) where size <= 1000000"),
        ("texts", "select f.*, d.text from (select * from files where route = 'text') f "
                  "join (select blob_sha, text from doc_files) d using (blob_sha)"),
        ("docs", "select distinct blob_sha, text from texts"),
        *matches(SECRETS + PII, "docs", KEY),
        *log_counts("docs", KEY),
        ("keyword_docs", "select distinct account_id, blob_sha, text from texts"),
        *keyword_ctes("keyword_docs", "account_id, blob_sha")[2:],
        keyword_first("account_id, blob_sha"),
        images_cte("image_metadata", KEY),
        ("image_found", image_findings(KEY, False)),
        ("names_found", names_sql("texts", file, True, True)),
        ("rows", f"""
            select {file}, line, rule, severity, {REDACTED} redacted_evidence, null metadata,
                   case when rule_ord < {FIRST_PII} then 0 else 1 end scanner_ord, rule_ord, match_ord
            from texts join kept using (blob_sha)
            union all select {file}, null, rule, severity, redacted_evidence, null, scanner_ord, rule_ord, 0
            from names_found
            union all select {file}, null, 'large-log-file', 'medium', {LOG_EVIDENCE}, null, 4, 0, 0
            from texts join log_counts using (blob_sha) where {LARGE}
            union all select {file}, line, 'custom-keyword', {KEYWORD_SEVERITY},
                   concat('Keyword match: "', m, '"'), null, 5, 0, match_ord
            from texts join keyword_first using (account_id, blob_sha)
            union all select {file}, null, rule, severity, redacted_evidence, metadata, 0, rule_ord, 0
            from files join image_found using (blob_sha) where route = 'image'"""),
        ("findings", f"""select account_id account, repo, path file, line, commit_sha "commit", rule, severity,
            redacted_evidence, metadata, {ACTION} suggested_action, account_ord, repo_ord, commit_ord,
            scanner_ord, coalesce(line, 0) line_ord, rule_ord, match_ord from rows"""),
    ]


SCAN_INPUTS = ["raw_accounts", "repos", "commits", "raw_tree", "doc_files", "image_metadata"]
ORDER = ("account_ord, repo_ord, repo, commit_ord, \"commit\", file, scanner_ord, line_ord, rule_ord, match_ord")
FINDING = ("account, repo, file, line, \"commit\", rule, severity, redacted_evidence, metadata, "
           "suggested_action")
RANK = "(case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end)"


def on_scan(select: str, more: list[tuple[str, str]] = [], inputs: list[str] = []) -> str:  # noqa: B006
    return statement(SCAN_INPUTS + inputs, scan_ctes(ENABLED) + more, select)


BLOCK = f"""concat('### ', upper(severity), ': ', rule, chr(10), '- Account: ', account, chr(10), '- Repo: ', repo,
    chr(10), '- File: ', file, chr(10), case when line is null then '' else concat('- Line: ', line, chr(10)) end,
    '- Commit: ', "commit", chr(10), '- Rule: ', rule, chr(10), '- Redacted evidence: ', redacted_evidence, chr(10),
    case when metadata is null then '' else concat('- Metadata: ', metadata, chr(10)) end,
    '- Suggested action: ', suggested_action, chr(10))"""
FIX = """concat('### ', upper(severity), ': ', rule, ' in ', file,
    case when line is null then '' else concat(' (line ', line, ')') end, chr(10),
    '- What was found: ', redacted_evidence, chr(10), '- Action: ', suggested_action, chr(10),
    '- Commit to check: ', left("commit", 7), chr(10))"""
UNIQUE = ("uniq", f"select * from findings qualify row_number() over "
                  f"(partition by repo, file, rule, coalesce(line, 0) order by {ORDER}, "
                  "redacted_evidence) = 1")
COUNTS = ", ".join(f"count(*) filter (where severity = '{s}') \"{s}\"" for s in V.SEVERITIES)
BY_ACCOUNT = ("by_account", f"select account, count(*) findings, {COUNTS} from findings group by account "
                            f"union all select null, count(*), {COUNTS} from findings")
TOTALS = ("totals", "select (select count(*) from scanned) accounts, (select count(*) from chosen) repos, "
                    "(select count(*) from scanned_commits) commits")


def summary(accounts: str) -> str:
    return f"""concat('# Privacy Report', chr(10), 'Generated: {FINISHED_AT}', chr(10), chr(10), '## Summary', chr(10),
        '- Accounts scanned: ', {accounts}, chr(10), '- Repositories scanned: ', t.repos, chr(10),
        '- New commits scanned: ', t.commits, chr(10), '- Findings: ', findings, chr(10),
        '  - Critical: ', critical, chr(10), '  - High: ', high, chr(10), '  - Medium: ', medium, chr(10),
        '  - Low: ', low, chr(10))"""


FIX_ROWS = ("fix_rows", f"""select account, account_ord, repo_ord, repo, 0 part, concat('## Repo: ', repo, chr(10)) as text,
      null commit_ord, null "commit", null file, null scanner_ord, null line_ord, null rule_ord, null match_ord
      from findings group by account, account_ord, repo_ord, repo
    union all select account, account_ord, repo_ord, repo, 1, {FIX}, commit_ord, "commit", file, scanner_ord,
      line_ord, rule_ord, match_ord from uniq""")
REPORT_KEYS = ("account, section, severity_rank, account_ord, repo_ord, repo, part, commit_ord, \"commit\", file, "
               "scanner_ord, line_ord, rule_ord, match_ord, text")


def fixed(section: int, severity: int, part: int, text: str) -> str:
    return (f"select account, {section}, {severity}, null, null, null, {part}, null, null, null, null, null, null, "
            f"null, {q(text)} from by_account where account is {{owner}} and findings > 0")


def report_rows(accounts: str, owner: str) -> str:
    rows = REPORT.replace("{owner}", owner).replace("{summary}", summary(accounts))
    return rows if owner == "not null" else rows.replace("select account,", "select null account,")


CLEAR = "case when findings = 0 then concat(chr(10), 'No findings. All clear.', chr(10)) else '' end"
REPORT = f"""select {REPORT_KEYS} from (
    select account, 0 section, null severity_rank, null account_ord, null repo_ord, null repo, null part,
      null commit_ord, null "commit", null file, null scanner_ord, null line_ord, null rule_ord, null match_ord,
      concat({{summary}}, {CLEAR}) as text from by_account, totals t where account is {{owner}}
    union all {fixed(1, -1, -1, FIX_LIST_OPENING)}
    union all select account, 1, 0, account_ord, repo_ord, repo, part, commit_ord, "commit", file, scanner_ord,
      line_ord, rule_ord, match_ord, text from fix_rows
    union all {fixed(1, 4, 2, FIX_LIST_CLOSING)}
    union all {fixed(2, -1, -1, "## Findings" + chr(10))}
    union all select account, 2, {RANK}, account_ord, repo_ord, repo, 0, commit_ord, "commit", file, scanner_ord,
      line_ord, rule_ord, match_ord, {BLOCK} from findings) r"""

# ---------------------------------------------------------------- state
NEW = ("fresh", """select c.account_id, c.repo, c.commit_sha, c.date from commits c where not exists (select 1
    from scanned s where s.account_id = c.account_id and s.repo = c.repo and s.commit_sha = c.commit_sha)""")
NEXT = ("next", f"""select account_id, repo, commit_sha last_scanned_sha, date last_scanned_date,
    '{SEEN_AT}' last_scanned_at from (select * from fresh union all
      select account_id, repo, last_scanned_sha, last_scanned_date from cursors
      where (account_id, repo) in (select account_id, repo from fresh)) every_one qualify row_number() over
    (partition by account_id, repo order by date desc, commit_sha desc) = 1""")


def ledger() -> str:
    more = [
        ("per_account", """select s.account_id, s.account_ord,
            (select count(*) from chosen c where c.account_id = s.account_id) account_repos,
            (select count(*) from scanned_commits c where c.account_id = s.account_id) account_commits,
            (select count(*) from findings f where f.account = s.account_id) account_findings from scanned s"""),
    ]
    over = "over (order by account_ord)"
    return on_scan(
        f"""select row_number() {over} + (select max(run_id) from runs) run_id, '{SEEN_AT}' started_at,
            '{FINISHED_AT}' finished_at, account_id, sum(account_repos) {over} repos_scanned,
            sum(account_commits) {over} commits_scanned, sum(account_findings) {over} findings_count,
            account_repos, account_commits, account_findings from per_account""",
        more, ["runs"],
    )


def file_findings(ctes: list[tuple[str, str]], rows: str, inputs: list[str]) -> str:
    return statement(inputs, ctes, f"""select account_id account, repo, path file, line, commit_sha "commit", rule,
        severity, redacted_evidence, {ACTION} suggested_action from ({rows}) r""")


def redacted_documents() -> str:
    """Each line goes through the rules one after the other: split at the matches, put together again."""
    steps, text = [], "l"
    for nth, (_, rule, _, pattern, _) in enumerate(PII):
        shown = REDACTED.replace("rule ", f"{q(rule)} ")
        steps.append((f"step{nth}", f"""select doc_id, line, array_to_string(list_transform(
            range(1, len(gaps) + 1), lambda i: concat(gaps[i], coalesce(list_transform([found[i]],
              lambda m: case when m is null or {FALSE_POSITIVE} then m else {shown} end)[1], ''))), '') as l
            from (select doc_id, line, string_split_regex(l, {re2(pattern)}) gaps, regexp_extract_all(l, {re2(pattern)}) found
                  from {f"step{nth - 1}" if nth else "lines"}) x"""))
    last = f"step{len(PII) - 1}"
    return statement([], [lines_cte("documents", "doc_id"), *steps], f"""select doc_id, md5(t) text_md5, t <> text as changed
        from (select doc_id, string_agg(l, chr(10) order by line) t from {last} group by doc_id) x join documents using (doc_id)""")


FILE = "account_id, repo, path, commit_sha"
DATED = "cast(cast(to_timestamp(1704067200 + doc_id * 600) at time zone 'UTC' as date) as varchar)"


def statements() -> dict[str, str]:
    by_rule = {
        "pii_email": "email-address", "pii_uk_phone": "uk-phone", "pii_us_phone": "us-phone",
        "pii_uk_postcode": "uk-postcode", "pii_discord_invite": "discord-handle",
        "pii_discord_user": "discord-username", "pii_ipv4": "ipv4-address",
        "secret_google_api_key": "google-api-key", "secret_aws_access_key": "aws-access-key",
        "secret_aws_secret_key": "aws-secret-key", "secret_private_key_block": "private-key-block",
        "secret_env_value": "env-secret-value", "secret_database_url": "database-url",
        "secret_discord_webhook": "discord-webhook", "secret_github_token": "github-token",
        "secret_openai_key": "openai-key", "secret_sk_ant_key": "anthropic-key",
        "secret_azure_key": "azure-key", "secret_gcp_service_account": "gcp-service-account",
        "secret_bearer_token": "bearer-token", "secret_high_entropy": "high-entropy-string",
    }
    sql = {name: rule_sql(rule) for name, rule in by_rule.items()}
    doc = ["doc_files"]
    strict = "|".join(s.replace(".", r"\.") for s in V.TEXT_SUFFIXES)
    sql |= {
        "accounts_normalized": statement(["raw_accounts"], [ACCOUNTS],
            "select account_id, \"user\", account_ord, contact_email, cc_email, "
            "array_to_string(list_sort(keywords), ',') keywords, enabled from accounts"),
        "repos_shaped": statement(["raw_repos"], [], """select c_custkey, coalesce(name, full_name, 'unknown') as name,
            coalesce(full_name, name, 'unknown') repo, coalesce(default_branch, 'main') default_branch,
            coalesce(fork, false) fork, coalesce(archived, false) archived, coalesce(pushed_at, '') pushed_at
            from raw_repos"""),
        "commits_shaped": """select md5(cast(o_orderkey as varchar)) sha,
            concat('order ', o_orderkey, ' ', o_orderpriority) message,
            case when o_orderkey % 4 <> 0 then cast(cast(o_orderdate as date) as varchar)
              when o_orderkey % 8 <> 0 then concat(cast(o_orderdate as date), 'c') else '' end date,
            case when o_orderkey % 3 <> 0 then concat('author ', o_orderkey % 50)
              when o_orderkey % 9 <> 0 then concat('login', o_orderkey % 50) else 'unknown' end author
            from orders""",
        "tree_blobs": statement(["raw_tree"], [TREE], "select *, 'file' as type from tree"),
        "content_decoded": """select doc_id, md5(t) text_md5, length(t) n_chars from (
            select doc_id, case when doc_id % 4 = 1 then decode(from_base64(to_base64(encode(text))))
              when doc_id % 4 = 0 or doc_id % 8 = 7 then text end t from documents) d where t is not null""",
        "gists_shaped": """select c_mktsegment description,
            case when c_custkey % 29 = 0 then '' else concat('g', c_custkey) end gist_id,
            case c_custkey % 3 when 0 then 'a.txt,b.md' when 1 then 'notes.md' else '' end files,
            c_custkey % 4 <> 0 and c_custkey % 2 = 0 as public,
            case when c_custkey % 5 = 0 then '' else '2024-01-01T00:00:00Z' end updated_at from customer""",
        "gist_files": """select case when c_custkey % 29 <> 0 then concat('g', c_custkey) end gist_id,
            case c_custkey % 3 when 0 then 'a.txt' else 'notes.md' end path,
            case c_custkey % 3 when 0 then c_name else c_mktsegment end as text
            from customer where c_custkey % 3 < 2""",
        "release_assets_flat": """select concat('repo_', o_custkey) repo, o_orderkey * 10 + i asset_id,
            concat('asset', i, '-', o_orderpriority) as name,
            concat('https://files.example.org/', o_orderkey, '/', i) url
            from orders, (values (0), (1)) n(i) where o_orderkey % 4 = 3 or (o_orderkey % 4 = 2 and i = 0)""",
        "files_source": statement(doc, [], "select doc_id, path, md5(text) text_md5, length(text) n_chars from doc_files"),
        "accounts_enabled": statement(["raw_accounts"], [ACCOUNTS], "select account_id, \"user\" from accounts where enabled"),
        "account_by_id": statement(["raw_accounts"], [ACCOUNTS],
            "select account_id, \"user\", enabled from accounts where account_id = 'acct_4'"),
        "repos_filtered": statement(["raw_repos"], [], """select c_custkey, coalesce(full_name, name, 'unknown') repo,
            coalesce(pushed_at, '') pushed_at from raw_repos where fork is not true and archived is not true"""),
        "files_size_ok": statement(["raw_tree"], [TREE],
            "select commit_sha, path, blob_sha, size from tree where size <= 1000000"),
        "route_files": statement(["raw_tree"], [TREE], f"""select commit_sha, path, case when size > 1000000 then 'skip'
            when {IS_IMAGE} then 'image' else 'text' end route from tree"""),
        "route_files_strict": statement(["raw_tree"], [TREE], f"""select commit_sha, path,
            case when size > 1000000 then 'skip' when {IS_IMAGE} then 'image'
              when regexp_matches(lower(path), '({strict})$') then 'text' else 'skip' end route from tree"""),
        "file_basenames": statement(["raw_tree"], [("slashed", """select commit_sha, path from raw_tree
            union all select commit_sha, replace(path, '/', '\\') from raw_tree
            union all select commit_sha, concat(path, '/') from raw_tree""")],
            f"select commit_sha, path, {BASE} base from slashed"),
        "pii_false_positives": statement(doc, matches(PII, "doc_files", "doc_id"),
            f"select doc_id, line, rule, m as match, {FALSE_POSITIVE} dropped from found"),
        "doc_lines": statement(doc, [lines_cte("doc_files", "doc_id")], "select doc_id, line, md5(l) line_md5 from lines"),
        "pii_matches": statement(doc, matches(PII, "doc_files", "doc_id"),
            "select doc_id, line, rule, severity, match_ord, m as match from kept"),
        "pii_redacted": statement(doc, matches(PII, "doc_files", "doc_id"),
            f"select doc_id, line, rule, {REDACTED} redacted_evidence from kept"),
        "pii_findings": file_findings(
            matches(PII, "doc_files", FILE) + [("named", names_sql("doc_files", FILE, True, False))],
            f"select {FILE}, line, rule, severity, {REDACTED} redacted_evidence from kept "
            f"union all select {FILE}, null, rule, severity, redacted_evidence from named", doc),
        "suspicious_filenames": statement(["raw_tree"], [("named", names_sql("raw_tree", "commit_sha, path", True, False))],
            "select commit_sha, path, rule, severity, redacted_evidence from named"),
        "secret_redacted": statement(doc, matches(SECRETS, "doc_files", "doc_id"),
            f"select doc_id, line, rule, {REDACTED} redacted_evidence from kept"),
        "token_entropy": statement(doc, [lines_cte("doc_files", "doc_id"),
            ("chars", "select doc_id, line, unnest(string_split(l, '')) c from lines where l <> ''")],
            "select doc_id, line, round(entropy(c), 6) entropy from chars group by doc_id, line"),
        "secret_findings": file_findings(matches(SECRETS, "doc_files", FILE),
            f"select {FILE}, line, rule, severity, {REDACTED} redacted_evidence from kept", doc),
        "filename_risk": statement(["raw_tree"], [("named", names_sql("raw_tree", "commit_sha, path", False, True))],
            "select commit_sha, path, rule, severity, redacted_evidence from named"),
        "filename_risk_by_rule": statement(["raw_tree"], [("named", names_sql("raw_tree", "commit_sha, path", False, True))],
            "select rule, severity, count(*) n from named group by rule, severity"),
        "log_line_counts": statement(doc, log_counts("doc_files", "doc_id"), "select * from log_counts"),
        "large_log_files": statement(doc, log_counts("doc_files", "doc_id"), f"select * from log_counts where {LARGE}"),
        "privacy_risk_findings": file_findings(
            log_counts("doc_files", "doc_id") + [("named", names_sql("doc_files", FILE, False, True))],
            f"select {FILE}, null line, rule, severity, redacted_evidence from named union all "
            f"select {FILE}, null, 'large-log-file', 'medium', {LOG_EVIDENCE} from doc_files join log_counts "
            f"using (doc_id) where {LARGE}", doc),
        "keyword_patterns": statement(["raw_accounts"], [ACCOUNTS, PATTERNS], "select * from patterns"),
        "keyword_matches": statement(doc + ["raw_accounts"], keyword_ctes("doc_files", "doc_id"),
            "select doc_id, line, match_ord, m as match from keyword_found"),
        "keyword_severity": statement(doc + ["raw_accounts"], keyword_ctes("doc_files", "doc_id"),
            f"select lower(m) keyword, max({KEYWORD_SEVERITY}) severity, count(*) n from keyword_found group by lower(m)"),
        "keyword_findings": file_findings(
            keyword_ctes("doc_files", "doc_id, " + FILE) + [keyword_first("doc_id, " + FILE)],
            f"select {FILE}, line, 'custom-keyword' rule, {KEYWORD_SEVERITY} severity, "
            "concat('Keyword match: \"', m, '\"') redacted_evidence from keyword_first", doc + ["raw_accounts"]),
        "exif_parsed": statement(["image_files"], [images_cte("image_files", "p_partkey")], "select * from images"),
        "exif_gps": statement(["image_files"], [images_cte("image_files", "p_partkey")],
            "select p_partkey, gps_lat, gps_lng from images where has_gps"),
        "exif_findings": statement(["image_files"], [images_cte("image_files", "p_partkey, path")],
            f"select p_partkey, path, rule, severity, redacted_evidence, metadata from ({image_findings('p_partkey, path', False)}) f"),
        "exif_findings_exact": statement(["image_files"], [images_cte("image_files", "p_partkey, path")],
            f"select p_partkey, path, rule, severity, redacted_evidence, metadata from ({image_findings('p_partkey, path', True)}) f"),
        "scan_plan": on_scan("select account_id, repo, commit_sha, path, blob_sha, route from files"),
        "all_findings": on_scan(f"select {FINDING} from findings"),
        "account_findings": statement(SCAN_INPUTS, scan_ctes(ONE), f"select {FINDING} from findings"),
        "severity_counts": on_scan("""select i severity_rank, s.severity, count(f.severity) n
            from (values (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low')) s(i, severity)
            left join findings f on f.severity = s.severity group by i, s.severity"""),
        "run_totals": on_scan("""select 'accounts' metric, accounts n from totals union all
            select 'repos', repos from totals union all select 'commits', commits from totals
            union all select 'findings', count(*) from findings""", [TOTALS]),
        "findings_by_repo": on_scan("""select repo, count(*) n, min(account_ord) account_ord, min(repo_ord) repo_ord,
            min(commit_ord) commit_ord from findings group by repo"""),
        "findings_rollup": on_scan(f"select account, findings, critical, high, medium, low from by_account", [BY_ACCOUNT]),
        "unique_findings": on_scan(f"select severity, {ORDER}, rule, line, redacted_evidence from uniq", [UNIQUE]),
        "findings_sorted": on_scan(f"select {RANK} severity_rank, severity, {ORDER}, rule, line from findings"),
        "incremental_commits": statement(["commits", "scanned"], [NEW], "select * from fresh"),
        "incremental_commits_full": statement(["commits"], [], "select account_id, repo, commit_sha, date from commits"),
        "next_cursor": statement(["commits", "scanned", "cursors"], [NEW, NEXT], "select * from next"),
        "cursor_upsert": statement(["commits", "scanned", "cursors"], [NEW, NEXT], """select * from next union all
            select c.* from cursors c where not exists
            (select 1 from next n where n.account_id = c.account_id and n.repo = c.repo)"""),
        "unseen_gists": statement(["gists", "seen_gists"], [], """select distinct account_id, gist_id from gists g
            where not exists (select 1 from seen_gists s where s.account_id = g.account_id and s.gist_id = g.gist_id)"""),
        "gists_marked_seen": statement(["gists", "seen_gists"], [],
            f"select distinct account_id, gist_id, '{SEEN_AT}' seen_at from gists"),
        "unseen_assets": statement(["assets", "seen_assets"], [], """select * from assets a where not exists
            (select 1 from seen_assets s where s.account_id = a.account_id and s.asset_id = a.asset_id)"""),
        "assets_marked_seen": statement(["assets"], [], f"""select account_id,
            case when asset_id % 3 = 0 then concat(repo, '-old') else repo end repo, asset_id, '{SEEN_AT}' seen_at
            from assets"""),
        "last_run": statement(["runs"], [], "select * from runs order by run_id desc limit 1"),
        "last_finished_run": statement(["runs"], [],
            "select * from runs where finished_at is not null order by run_id desc limit 1"),
        "run_ledger": ledger(),
        "ledger_running_totals": statement(["runs"], [], """select account_id, run_id, findings_count,
            sum(findings_count) over (partition by account_id order by run_id) findings_so_far from runs"""),
        "finding_blocks": on_scan(f"select account, {RANK} severity_rank, {ORDER}, {BLOCK} as text from findings"),
        "report_summary": on_scan(f"select {summary('t.accounts')} as text from by_account, totals t where account is null",
            [BY_ACCOUNT, TOTALS]),
        "fix_list": on_scan("select * from fix_rows", [UNIQUE, FIX_ROWS]),
        "account_reports": on_scan(report_rows("1", "not null"), [UNIQUE, BY_ACCOUNT, TOTALS, FIX_ROWS]),
        "run_report": on_scan(report_rows("t.accounts", "null").replace(f"select null {REPORT_KEYS}", f"select {REPORT_KEYS[9:]}"),
            [UNIQUE, BY_ACCOUNT, TOTALS, FIX_ROWS]),
        "findings_cube": on_scan("""select rule, severity, account, count(*) n, grouping_id(rule, severity, account) as level
            from findings group by cube (rule, severity, account)"""),
        "pii_rate_by_quality": statement([], matches(PII, "documents", "doc_id"), """select quality, toxic, count(*) n,
            count(k.doc_id) n_found, round(count(k.doc_id) / count(*), 6) as share
            from labels l join documents d using (doc_id) left join (select distinct doc_id from kept) k using (doc_id)
            group by quality, toxic"""),
        "documents_redacted": redacted_documents(),
        "report_summaries": statement(["report_texts"], [], f"""select doc_id, case when contains(report, '## Summary')
            then rtrim(split_part(concat('## Summary', substr(report, strpos(report, '## Summary') + 10)),
              concat(chr(10), '## '), 1), concat(' ', chr(10), chr(9), chr(13)))
            else {q(NO_SUMMARY)} end summary from report_texts"""),
        "latest_report": statement(["report_files"], [], "select max(name) as name from report_files where name like '%.md'"),
        "digest": on_scan(f"""select s.account_id, s.contact_email "to",
            case when not (s.cc_email like 'REPLACE_%' or contains(s.cc_email, 'placeholder')) then s.cc_email end cc,
            concat('Privacy Report for ', s.account_id, ' — ', findings, ' finding',
              case when findings = 1 then '' else 's' end, ' — ', '{FINISHED_AT[:10]}') subject,
            findings, r.* exclude (account) from scanned s join by_account b on b.account = s.account_id
            join report r on r.account = s.account_id
            where not (s.contact_email like 'REPLACE_%' or contains(s.contact_email, 'placeholder'))""",
            [UNIQUE, BY_ACCOUNT, TOTALS, FIX_ROWS, ("report", report_rows("1", "not null"))]),
        "pii_by_source": statement([], matches(PII, "documents", "source"),
            "select source, rule, severity, count(*) n from kept group by source, rule, severity"),
        "pii_by_lang": statement([], matches(PII, "documents", "lang"),
            "select lang, rule, severity, count(*) n from kept group by lang, rule, severity"),
        "conversation_findings": statement(["chat_files"], matches(SECRETS + PII, "chat_files", "role"),
            "select role, rule, severity, count(*) n from kept group by role, rule, severity"),
        "page_findings": statement([], matches(SECRETS + PII, "pages", "url", "html"),
            """select regexp_extract(url, '^https?://([^/:?#]*)', 1) host, rule, severity, count(*) n
            from kept group by host, rule, severity"""),
        "stream_findings": statement(doc, matches(SECRETS + PII, "doc_files", "doc_id, path"),
            f"select doc_id, path, line, rule, severity, {REDACTED} redacted_evidence from kept"),
        "stream_unique_findings": statement(doc, matches(PII, "doc_files", "repo, path"),
            "select distinct repo, path, rule, line as line0 from kept"),
        "stream_severity_counts": statement(doc, matches(SECRETS + PII, "doc_files", "doc_id"),
            f"select {DATED} window_start, severity, count(*) n from kept group by 1, 2"),
        "stream_unseen_gists": statement(["gists"], [], "select distinct account_id, gist_id from gists"),
        "stream_run_ledger": statement(doc, matches(SECRETS + PII, "doc_files", "doc_id"),
            "select 0 batch_id, count(*) findings_count from kept"),
        "stream_ledger_totals": statement(doc, matches(SECRETS + PII, "doc_files", "account_id"),
            "select account_id, 0 batch_id, count(*) findings_count, count(*) findings_so_far from kept group by account_id"),
        "stream_first_findings": statement(doc, matches(PII, "doc_files", "doc_id, repo, path"),
            f"""select doc_id, repo, path, rule, line, {REDACTED} redacted_evidence from kept
            qualify row_number() over (partition by repo, path, rule, line order by doc_id, match_ord) = 1
            and min(doc_id) over (partition by repo, path, rule, line) * 600 + 86400 <= (select max(doc_id) from kept) * 600 - 3600"""),
    }
    sql["stream_assets_marked_seen"] = sql["assets_marked_seen"]
    return sql
