"""Credential detection and redaction; values are assembled at run time, so none stands in this file."""

import ast
import json

import pytest

from codelode.llm import credentials as c

RANDOM = "q7Zk" + "2vLw9XtB4mNc"
HEX = "0a1b2c3d" * 4
STRIPE = "sk_" + "live_" + "a1B2c3D4e5F6g7H8"
AWS = "AK" + "IA" + "ABCDEFGHIJ234567"
PEM = "-----BEGIN RSA " + "PRIVATE KEY-----"
BODY = "MIIEowIBAAKCAQEAx7Zk2vLw9XtB4mNcQ1aB"

HITS = [
    ("a.py", f'password = "{RANDOM}"'), ("a.py", f"API_KEY = '{HEX}'"), ("a.ts", f'const apiKey: string = "{RANDOM}";'), ("a.go", f'token := "{RANDOM}"'), ("a.rs", f'let db_pass: &str = "{RANDOM}";'), ("a.c", f'const char *client_secret = "{RANDOM}";'), ("a.cs", f'var signingKey = ("{RANDOM[:8]}"\n    + "{RANDOM[8:]}");'),
    ("a.json", f'"passwd": "{RANDOM}"'), ("a.yaml", f"pwd: {RANDOM}"), (".env", f"export access_token={RANDOM}"), ("a.ini", "passphrase = late_facet-51"), ("a.toml", 'smtp_password = "Quotavalid1881!"'), ("a.py", f'grip = "{STRIPE}"'), ("a.js", f'const id = "{AWS[:10]}" + "{AWS[10:]}";'),
    ("a.py", f"# works locally with token {RANDOM}"), ("a.py", f"x = 1  # old key, rotate later: {HEX}"), ("a.go", f'u := "postgres://svc:{RANDOM}@db.example:5432/x"'), ("a.cs", f'var c = "Server=a;Uid=b;Pwd={RANDOM};";'), ("a.py", f'h = "Authorization: Bearer {RANDOM}"'), ("a.md", f"curl -u user:{RANDOM} https://x.example"),
    ("a.py", f'open_session("db.x.example", "row_rw", "{RANDOM}")'), ("a.ts", f'openSession(host, user, "plain_row#47");'), ("a.sh", f"export DB_PASSWORD={RANDOM}\nexport OTHER=2"), ("Dockerfile", f"FROM x\nENV DB_PASSWORD {RANDOM}\nENV A 1"), ("a.c", f'#define DB_PASSWORD "{RANDOM}"'), ("a.xml", f"<a><password>{RANDOM}</password></a>"),
    ("a.py", f'tokens = [\n    "{RANDOM}",\n]'), ("a.py", f'if password == "{RANDOM}": pass'), ("a.py", f'login("bob", "{RANDOM}")'), ("a.py", 'password = "swordfish"'), ("a.py", 'password = "pässwörd99"'), ("a.py", 'passphrase = "correct horse battery staple"'), ("a.yaml", f'section:\n  admin_pw: "{RANDOM}"'), ("a.py", f'password = {"(" + " " * 300}"{RANDOM}")'),
    ("k.pem", f"{PEM}\n{BODY}\n-----END RSA PRIVATE KEY-----"), ("a.py", f'pem = """\\\n{PEM}\n{BODY}\n"""'), ("a.js", f'const p = "{PEM}\\n{BODY}\\n";'), ("a.py", f'conf.set_password("{RANDOM}")'), ("a.py", f'd.put("password", "{RANDOM}")'),
]

MISSES = [
    ("a.py", 'password = ""'), ("a.py", 'password = "YOUR_PASSWORD_HERE"'), ("a.py", 'api_key = "xxxxxxxxxxxx"'), ("a.py", 'pwd = "<redacted>"'), ("a.py", 'secret = "${DB_PASS}"'), ("a.py", 'token = os.environ["AUTH_TOKEN"]'), ("a.yaml", 'api_key: "vault:kv/x"'), ("a.yaml", "pwd: env:PWD"), ("a.json", '"client_secret": "{{ vault.x }}"'),
    ("a.py", 'password = "changeit-placeholder"'), ("a.py", 'secret = "not-a-real-ADMIN_PW"'), ("a.py", 'token = "dummy_auth_token"'), ("a.py", 'pwd = "********"'), ("a.py", 'pwd = "%(DB)s"'), ("a.py", 'd = "redis://u:%s@h.example/x"'), ("a.py", 'd = "redis://u:<password>@h.example/x"'), ("a.md", "curl -H 'Authorization: Bearer $TOKEN' https://x"),
    ("a.py", 'secret_name = "idle-row"'), ("a.py", 'password_field = "dirty-step"'), ("a.py", f'checksum = "{HEX}"'), ("a.py", f'key_id = "{HEX}"'), ("a.py", '# api_key must be rotated every 47 days'), ("a.py", "# the password is read from the keyring at start"), ("a.py", '"token": "tight policy, interim archive"'), ("a.py", f'if token == "{RANDOM}": pass'),
    ("a.py", f'p = "-----BEGIN PUBLIC KEY-----\\n{BODY}"'), ("a.py", f'if x.startswith("{PEM}"): pass'), ("a.js", "const token = loadJournal(tuple, 2738);"), ("a.py", 'password = "required"'), ("a.py", 'connect("db.host.example", "table_2")'), ("a.py", 'secret = "The value of this field is wrong."'), ("a.py", 'login("bob", name)'), ("a.py", ""), ("a.bin", "\x00\x01"), (None, "plain"), ("go.sum", f"x v1 h1:{HEX}="),
]


@pytest.mark.parametrize(("path", "text"), HITS)
def test_found_and_masked(path, text):
    found = c.find(text, path)
    assert len(found) == 1, found
    masked = c.redact(text, found)
    assert len(masked) == len(text) and masked.count("\n") == text.count("\n")
    assert c.find(masked, path) == []
    for piece in (RANDOM, HEX, STRIPE, AWS, BODY):
        assert piece not in masked


@pytest.mark.parametrize(("path", "text"), MISSES)
def test_not_found(path, text):
    assert c.find(text, path) == []


def test_masked_text_stays_valid():
    text = f'x = {{"password": "a\\u00e9{RANDOM}", "u": f"mysql://u:{RANDOM}@h.example/x"}}\n'
    ast.parse(c.redact(text, c.find(text, "a.py")))
    doc = json.dumps({"api_key": 'q"7\n' + RANDOM, "n": 1})
    assert set(json.loads(c.redact(doc, c.find(doc, "a.json")))) == {"api_key", "n"}


def test_block_over_two_chunks_is_masked_in_both():
    first, second = f"x = 1\n{PEM}\n{BODY}", f"{BODY}\n-----END RSA PRIVATE KEY-----\ny = 2"
    assert BODY not in c.redact(first, c.find(first, "k.txt"))
    masked = c.redact(second, c.find(second, "k.txt"))
    assert BODY not in masked and masked.endswith("y = 2")


def test_an_open_block_leaves_the_code_behind_it_alone():
    text = f'K = "{PEM}\\n{BODY}\\nab1="\nprint(K)\n'
    masked = c.redact(text, c.find(text, "a.py"))
    assert BODY not in masked and masked.endswith('"\nprint(K)\n')


CHUNKS = "chunk_id long, project string, file string, chunk_index int, start_line int, text string"


def test_a_key_over_many_chunks_counts_once_and_is_masked_in_all(spark):
    other = [BODY[::-1] + str(k) for k in range(4)]
    texts = [f"x = 1\n{PEM}\n{BODY}", other[0], f"{other[1]}\n{other[2]}", f"{other[3]}\n-----END RSA PRIVATE KEY-----\ny = 2"]
    starts = [1, 4, 5, 7]
    rows = [(k, "p", "k.txt", k, starts[k], t) for k, t in enumerate(texts)] + [(9, "p", "k.txt", 1, 4, "z = 3")]
    df = spark.createDataFrame(rows, CHUNKS)
    assert [tuple(r) for r in c.credentials(df).select("chunk_id", "line_no").collect()] == [(0, 2)]
    masked = {r.chunk_id: r.text for r in c.redacted(df).collect()}
    assert not any(piece in t for piece in [BODY, *other] for t in masked.values())
    assert masked[3].endswith("\n-----END RSA PRIVATE KEY-----\ny = 2") and masked[9] == "z = 3"
    assert all(len(masked[k]) == len(texts[k]) for k in range(4))


def test_a_literal_over_the_border_of_chunks_is_not_read_inside_out(spark):
    rows = [(1, "p", "a.py", 0, 1, 'doc = """\nfirst "part'), (2, "p", "a.py", 1, 3, f'rest\n"""\npassword = "{RANDOM}"\n'), (3, "p", "b.py", 0, 1, 'password = (\n'), (4, "p", "b.py", 1, 3, f'    "{RANDOM}"\n)')]
    got = sorted(tuple(r) for r in c.credentials(spark.createDataFrame(rows, CHUNKS)).select("chunk_id", "line_no").collect())
    assert got == [(2, 5), (4, 3)]


def test_over_dirty_chunks(spark):
    ddl = "chunk_id long, project string, file string, chunk_index int, start_line int, text string, path string, form string"
    rows = [(1, "p", "a.py", 0, 5, f'x = 1\npassword = "{RANDOM}"', "clash", None), (1, "p", "a.py", 0, 5, f'x = 1\npassword = "{RANDOM}"', "clash", None), (2, None, None, None, None, f"t = '{STRIPE}'", None, None), (3, "p", "a.py", 0, 1, None, None, None), (4, "p", "b.py", 0, 1, "", None, None), (5, "p", "c.txt", 0, 1, "word " * 60_000, None, None)]
    df = spark.createDataFrame(rows, ddl)
    assert sorted(map(tuple, c.credentials(df).select("chunk_id", "line_no").distinct().collect())) == [(1, 6), (2, 1)]
    masked = c.redacted(df)
    assert masked.count() == 5 and masked.where("values_masked > 0").count() == 3
    assert c.credentials(spark.createDataFrame([], ddl)).count() == 0
