"""Inputs that the audit needs and the test tables do not have, derived from those tables.

Each entry is SQL that Spark and DuckDB both understand; ``{name}`` stands for another table or
input.  All rows of the base tables are used, so the inputs grow with them.  Keys and tokens are
fakes built from pieces and hashes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import read_table

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def planted(number: str) -> str:
    """SQL text value for an integer: one of 34 lines that rules must or must not report."""
    h = f"md5(cast({number} as string))"
    n = f"cast({number} as string)"
    lines = [
        f"concat('AI', 'zaSy', {h}, 'FakeK')",
        "concat('AI', 'zaShort')",
        f"concat('id AK', 'IA', upper(substr({h}, 1, 16)), ' ok')",
        "concat('AK', 'IATESTKEY12345678')",
        f"concat('AWS_SECRET_ACCESS_KEY=', {h}, 'ABCDEF0/')",
        "concat('-----BEGIN ', 'RSA PRIVATE', ' KEY-----')",
        "concat('-----BEGIN ', 'PUBLIC KEY-----')",
        f"concat('API_KEY=s', 'k-test', {h})",
        f"concat('JWT_SECRET=', {h})",
        f"concat('DATABASE_URL=postgres://user:', {h}, '@localhost:5432/mydb')",
        "'postgres://localhost:5432/mydb'",
        f"concat('https://discord.com/api/web', 'hooks/', {n}, '/abc-', {h})",
        f"concat('gh', 'p_', {h}, 'a1B2')",
        f"concat('s', 'k-ant-', {h})",
        f"concat('Account', 'Key=', {h}, {h}, substr({h}, 1, 22), '==')",
        "concat('{{ \"type\": ', '\"service_account\" }}')",
        f"concat('Authorization: Bea', 'rer ', {h})",
        f"concat('token = \"', {h}, 'ABCDEF01\"')",
        "concat('token = \"', repeat('a', 40), '\"')",
        f"concat('write to mira.holt', {n}, '@north-post.co.uk, not to x@example.com')",
        "'a@1.2.3.com and b@mail.org'",
        f"concat('ring 0161 496 ', lpad({n}, 4, '0'), ' after six.')",
        "'+44 7700 900461'",
        "'from EH8 9YL to B12QP'",
        f"concat('see discord.gg/AbC', {n}, ' or DISCORD.GG/x')",
        f"concat('mira_h', {n}, '#4821')",
        f"concat('127.0.0.1 10.0.0.', cast({number} % 250 as string), ' 255.255.255.255')",
        "'0123456789'",
        "'é0123456789'",
        "'me@test.com root@localhost.localdomain a@example.community b@mail6.example.com'",
        "'(020) 123-4567 and (212) 555-0100'",
        "'nothing to see here'",
        f"repeat(concat('ERROR step ', {n}, chr(10)), cast(60 + {number} % 90 as int))",
        "repeat(concat('  at run (app.js:10:5)', chr(10), 'ERROR', chr(10)), 120)",
    ]
    cases = " ".join(f"when {i} then {line}" for i, line in enumerate(lines))
    return f"(case {number} % {len(lines)} {cases} end)"


def file_path(number: str) -> str:
    """SQL path for an integer: names that the file-name rules know and plain ones."""
    names = [
        "'.env'", "'config/.env.local'", "'secrets.yml'", "'credentials.json'", "'keys/id_rsa'",
        "'certs/server.pem'", "'certs/site.key'", "'config.json'", "'service-account-prod.json'",
        "'a.p12'", "'b.pfx'", "'c.keystore'", "'screenshot_1.txt'", "'img_photo.txt'",
        "'logs/app.log'", "'chat_export_chat.txt'", "'pics/holiday.JPG'", "'invoice-contact.md'",
    ]
    cases = " ".join(f"when {i} then {name}" for i, name in enumerate(names))
    return f"(case {number} % 20 {cases} else concat('src/file_', cast({number} as string), '.ts') end)"


def metadata_json(number: str) -> str:
    n = f"cast({number} as string)"
    return f"""(case when {number} % 11 = 0 then 'not json' when {number} % 11 = 1 then '[]' else
    concat('[{{{{"SourceFile":"x.jpg"',
      case when {number} % 3 = 0 then concat(',"GPSLatitude":', {n}, '.5,"GPSLongitude":-0.25')
           when {number} % 3 = 1 then ',"GPSLatitude":null,"GPSLongitude":null' else '' end,
      case when {number} % 4 = 0 then concat(',"SerialNumber":"SN', {n}, '00"')
           when {number} % 4 = 1 then ',"SerialNumber":"","InternalSerialNumber":"INT9"'
           when {number} % 4 = 2 then concat(',"InternalSerialNumber":"I', {n}, '"')
           when {number} % 8 = 3 then ',"SerialNumber":"0"' else ',"SerialNumber":0.0' end,
      case when {number} % 5 = 0 then concat(',"OwnerName":"Owner ', {n}, '"')
           when {number} % 5 = 1 then ',"OwnerName":"false"' when {number} % 5 = 2 then ',"OwnerName":-0'
           when {number} % 5 = 3 then ',"OwnerName":false' else '' end,
      case when {number} % 2 = 0 then ',"Model":"Cam A"' else ',"Model":null' end,
      case when {number} % 7 = 0 then ',"CreateDate":"2024:01:01 00:00:00"' else '' end,
      ',"Software":"17.0.1"}}}}]', case when {number} % 11 = 2 then ' junk' else '' end) end)"""


DERIVED = {
    # texts: every document with one planted line at its end
    "doc_files": f"""
        select doc_id, source, lang, concat('acct_', doc_id % 25) account_id,
               concat('acct_', doc_id % 25, '/repo_', doc_id % 200) repo,
               md5(cast(doc_id as string)) blob_sha, md5(cast(doc_id + 1 as string)) commit_sha,
               {file_path("doc_id")} path, concat(text, chr(10), {planted("doc_id")}) text
        from {{documents}}""",
    "chat_files": f"""
        select conv_id, turn, role, concat(text, chr(10), {planted("(conv_id * 7 + turn)")}) text
        from {{conversations}}""",
    # account list as loaded
    "raw_accounts": """
        select concat('acct_', n_nationkey) account_id, concat('user_', n_nationkey) "user",
               case when n_nationkey % 7 = 3 then null else n_nationkey % 5 <> 4 end enabled,
               n_nationkey account_ord,
               case n_nationkey % 6 when 0 then 'REPLACE_WITH_CONTACT_EMAIL'
                 when 1 then concat('placeholder', n_nationkey, '@mail.org') when 2 then null
                 else concat('owner', n_nationkey, '@mail.org') end contact_email,
               case n_nationkey % 5 when 0 then 'REPLACE_WITH_CC_EMAIL'
                 when 1 then 'the.placeholder@mail.org' when 2 then null
                 else concat('cc', n_nationkey, '@mail.org') end cc_email,
               case n_nationkey % 3 when 0 then 'token,the' when 1 then concat('License,2.0.,', n_name)
                 else null end keyword_list
        from {nation}""",
    "raw_repos": """
        select c_custkey,
               case when c_custkey % 13 = 0 then null else concat('repo_', c_custkey) end name,
               case when c_custkey % 17 = 0 then null
                 else concat('acct_', c_nationkey, '/repo_', c_custkey) end full_name,
               case when c_custkey % 3 = 0 then null else 'trunk' end default_branch,
               case when c_custkey % 11 = 0 then null else c_custkey % 5 = 0 end fork,
               case when c_custkey % 19 = 0 then null else c_custkey % 7 = 0 end archived,
               case when c_custkey % 23 = 0 then null else
                 concat('2024-', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '-',
                        lpad(cast(1 + c_custkey % 28 as string), 2, '0'), 'T00:00:00Z') end pushed_at
        from {customer}""",
    "repos": """
        select concat('acct_', c_nationkey) account_id,
               concat('acct_', c_nationkey, '/repo_', c_custkey) repo,
               -(20240000 + (1 + c_custkey % 12) * 100 + 1 + c_custkey % 28) repo_ord,
               c_custkey % 5 = 0 fork, c_custkey % 7 = 0 archived
        from {customer}""",
    "commits": """
        select concat('acct_', c_nationkey) account_id,
               concat('acct_', c_nationkey, '/repo_', c_custkey) repo,
               md5(cast(o_orderkey as string)) commit_sha,
               case when o_orderkey % 41 = 0 then '' else cast(cast(o_orderdate as date) as string) end date,
               -cast(replace(cast(cast(o_orderdate as date) as string), '-', '') as int) commit_ord
        from {orders} join {customer} on o_custkey = c_custkey""",
    "raw_tree": f"""
        select md5(cast(l_orderkey as string)) commit_sha, md5(cast(l_partkey as string)) blob_sha,
               case when l_partkey % 37 = 0 then null
                 else cast(floor(l_extendedprice * 10) as bigint) end size,
               case when l_linenumber = 7 then 'tree' else 'blob' end type,
               {file_path("l_partkey")} path
        from {{lineitem}}""",
    "image_files": f"""
        select p_partkey, concat('pics/img_', p_partkey, '.jpg') path,
               {metadata_json("p_partkey")} meta_json
        from {{part}}""",
    "image_metadata": f"""
        select md5(cast(p_partkey as string)) blob_sha, {metadata_json("k")} meta_json
        from (select p_partkey, cast(floor(p_partkey / 20) as bigint) k from {{part}}
              where p_partkey % 20 = 16) p""",
    # what the runs before left behind; every 40th old commit arrived after them
    "scanned": """
        select account_id, repo, commit_sha, date from {commits}
        where commit_ord >= -19960630 and commit_ord % 40 <> 0 and date <> ''
        union all select account_id, repo, commit_sha, date from {commits} where date = '' and commit_ord % 3 = 0""",
    "cursors": """
        select account_id, repo, substr(newest, 12) last_scanned_sha, substr(newest, 1, 10) last_scanned_date,
               '2024-01-01T00:00:00Z' last_scanned_at
        from (select account_id, repo, max(concat(date, '|', commit_sha)) newest
              from {scanned} group by account_id, repo) c
        where substr(newest, 12, 1) <> '0'""",
    "gists": """
        select concat('acct_', c_nationkey) account_id, concat('g', c_custkey % 1000) gist_id, c_custkey
        from {customer}""",
    "seen_gists": """
        select account_id, gist_id, '2024-01-01T00:00:00Z' seen_at
        from {gists} where c_custkey % 3 = 0 group by account_id, gist_id""",
    "assets": """
        select concat('acct_', o_custkey % 25) account_id,
               concat('acct_', o_custkey % 25, '/repo_', o_custkey) repo, o_orderkey asset_id
        from {orders}""",
    "seen_assets": """
        select account_id, concat(repo, '-old') repo, asset_id, '2024-01-01T00:00:00Z' seen_at
        from {assets} where asset_id % 3 = 0""",
    "runs": """
        select event_id run_id, cast(cast(ts as date) as string) started_at,
               case when event_id % 10 = 9 then null else cast(cast(ts as date) as string) end finished_at,
               concat('acct_', user_id % 25) account_id, event_id % 97 findings_count
        from {events}""",
    "report_files": """
        select concat('audit-report-', cast(cast(ts as date) as string), '-',
                      lpad(cast(event_id as string), 10, '0'),
                      case when event_id % 5 = 4 then '.tmp' else '.md' end) name
        from {events}""",
    "report_texts": """
        select doc_id,
               case doc_id % 4
                 when 0 then concat('# Privacy Report', chr(10), chr(10), '## Summary', chr(10),
                                    '- Findings: ', n_chars, chr(10), chr(10), '## Findings', chr(10), text)
                 when 1 then concat('# Privacy Report', chr(10), '## Summary', chr(10), '- Findings: 0',
                                    chr(10), chr(10), 'No findings. All clear.', chr(10))
                 when 2 then concat('## Summary', chr(10), text)
                 else text end report
        from {documents}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _needs(name: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(DERIVED[name])) if n in DERIVED or n in BASE_TABLES]


def load(spark: SparkSession, folder: str, name: str, read=read_table) -> DataFrame:
    """A base table or derived input as a DataFrame; ``read`` may give a stream instead of a table."""
    if name in BASE_TABLES:
        return read(spark, folder, name)
    sql = DERIVED[name].replace('"user"', "`user`")
    return spark.sql(sql, **{n: load(spark, folder, n, read) for n in _needs(name)})


def with_inputs(names: list[str]) -> str:
    """``with a as (...), b as (...)`` for DuckDB, in order of need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in order:
            return
        for n in _needs(name):
            visit(n)
        order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} as ({DERIVED[n].format(**{k: k for k in _needs(n)})})" for n in order]
    return ",\n".join(parts)
