"""Configuration readers, and what credential search finds and masks through them."""

from __future__ import annotations

import pytest

from lakelens.llm import config, secrets


def read(text, ext):
    return [(".".join(x.path), text[x.start : x.end]) for x in config.leaves(text, ext)]


def test_json_paths_in_whole_and_cut_texts():
    assert read('{"db": {"password": {"current": "aB3"}}, "l": [{"name": "X", "value": "y"}, 3]}', "json") == [("db.password.current", "aB3"), ("l.0.name", "X"), ("l.0.X", "y"), ("l.1", "3")]
    assert read('"password": "x", // c\n "a": null}\n', "json") == [("password", "x"), ("a", "null")]
    cut = list(config.leaves('{"k": "trunc', "json"))
    assert [(x.path, x.cut_off) for x in cut] == [(("k",), True)]


def test_yaml_paths_blocks_flow_and_named_values():
    text = "db:\n  prod:\n    password: \"aB3#x\" # c\nenv:\n- name: DB_PASSWORD\n  value: xyz9!\n- name: B\n  value: \"q\"\nlist: [a, {token: t1}]\nkey: |\n  one\n\n  two\nlast: !!str &x val:ue\nsecrets:\n  - 'it''s'\n"
    assert read(text, "yaml") == [
        ("db.prod.password", "aB3#x"), ("env.name", "DB_PASSWORD"), ("env.DB_PASSWORD", "xyz9!"), ("env.name", "B"), ("env.B", "q"),
        ("list.0", "a"), ("list.1.token", "t1"), ("key", "one\n\n  two"), ("last", "val:ue"), ("secrets", "it''s"),
    ]


def test_line_formats_sections_quotes_arrays_and_continued_lines():
    assert read('[password]\nvalue = aB3dE5 ; c\n[a.b]\ndb.pass = "x\\"y" # z\nt = """\nm1\nm2"""\nin = { token = "tt", n = 3 }\narr = ["a",\n "b"]\n', "toml") == [
        ("password.value", "aB3dE5"), ("a.b.db.pass", 'x\\"y'), ("a.b.t", "\nm1\nm2"), ("a.b.in.token", "tt"), ("a.b.in.n", "3"), ("a.b.arr.0", "a"), ("a.b.arr.1", "b"),
    ]
    assert read("export A=\"b\"\nC=d#e #f\nLONG=ab\\\ncd\nD=\nE=1", "env") == [("A", "b"), ("C", "d#e"), ("LONG", "ab\\\ncd"), ("E", "1")]


@pytest.mark.parametrize("ext", ["json", "yaml", "ini", "env", "toml"])
@pytest.mark.parametrize("text", ["", "\n", "{", "]", ":", "- ", "= =\n[", '"', "'\n'", "\ufeff", "a:\n\tb: {c: [", "x" * 10_000, "- " * 2000, "{" * 5000])
def test_readers_take_any_text(text, ext):
    for x in config.leaves(text, ext):
        assert 0 <= x.start <= x.end <= len(text)


CASES = [
    ('{"db": {"password": {"current": "aB3dE5gH7jK9"}}}', "json", "aB3dE5gH7jK9", "db.password.current"),
    ("[password]\nvalue = aB3dE5gH7jK9\n", "ini", "aB3dE5gH7jK9", "password.value"),
    ('"db":\n  "password": \'aB3dE5gH7jK9\'\n', "yaml", "aB3dE5gH7jK9", "db.password"),
    ("# curl -u mirror:mittenMoss.5218 https://api.test/v2", "py", "mittenMoss.5218", ""),
    ("sshpass -p 'harborMoss!5488' scp a b:", "sh", "harborMoss!5488", ""),
    ("mysql -h db.test -u root -p'W4lnutL4ke_8692' app", "sh", "W4lnutL4ke_8692", ""),
    ("// pw for staging is lanternFox=3099x", "js", "lanternFox=3099x", ""),
    ("x = 1\n# old login svc-a / SaffronM0ss+7530\n", "py", "SaffronM0ss+7530", ""),
    ('const signingKey = process.env.SIGNINGKEY || "mitt3nRidge-1167";', "ts", "mitt3nRidge-1167", "signingKey"),
    ('"STORAGE_SECRET": "/jK0hx+8EV6Oo/wPdnGlFw1VlxaeJ6Q7/h9QpmwL"', "json", "/jK0hx+8EV6Oo/wPdnGlFw1VlxaeJ6Q7/h9QpmwL", "STORAGE_SECRET"),
]


@pytest.mark.parametrize("text,ext,value,path", CASES)
def test_found_with_path_and_masked(text, ext, value, path):
    (hit,) = secrets.find_credentials(text, ext)
    assert text[hit.start : hit.end] == value
    assert not path or hit.path in (path, "process.env.SIGNINGKEY")
    assert secrets.redact(text, ext) == text.replace(value, secrets.MASK)


@pytest.mark.parametrize("text,ext", [
    ("# the login page is described in src/core/load_rule37.py", "py"), ("# token count of load_rule_12 and parseRule37", "py"), ("# login with user@host.example for v2.10.4", "py"),
    ('{"password_hint": "aB3dE5gH7jK9", "token_count": "12ab34CD"}', "json"), ("curl -u $USER:$TOKEN https://a.test", "sh"), ("mysql -u root -p app", "sh"), ("password: ${DB_PASSWORD}\nsecret_name: prod/ledger/password\n", "yaml"),
])
def test_no_cases(text, ext):
    assert secrets.find_credentials(text, ext) == []


def test_byte_offsets_count_utf8():
    text = "# ключ\npassword: \"aB3dE5gH7jK9\"\nnote: \"ещё\"\ntoken: \"xY7dE5gH7jK9\"\n"
    hits = secrets.find_credentials(text, "yaml")
    raw = text.encode()
    assert [raw[a:b].decode() for a, b in secrets.byte_ranges(text, [r for h in hits for r in h.ranges])] == ["aB3dE5gH7jK9", "xY7dE5gH7jK9"]
    assert secrets.redact(text, "yaml") == text.replace("aB3dE5gH7jK9", secrets.MASK).replace("xY7dE5gH7jK9", secrets.MASK)


def test_long_values_are_masked_whole():
    value = "aB3dE5gH7jK9" * 1000
    for text, ext in ((f'password = "{value}"', "py"), (f"password: {value}", "yaml"), (f'{{"password": "{value}"}}', "json"), (f"Authorization: Bearer {value}", "md")):
        assert "aB3dE5gH7jK9" not in secrets.redact(text, ext)


@pytest.mark.parametrize("unit", ["curl ", '{"password": ', "password: {\n- {a: [", 'a: "x\n', 'x = password("', "# login ab_", "[", "- "])
def test_time_grows_with_the_text_only(unit):
    import time

    for ext in ("py", "yaml", "json", "ini", "md"):
        took = []
        for k in (500, 4000):
            start = time.process_time()
            secrets.find_credentials(unit * k, ext)
            took.append(time.process_time() - start)
        assert took[1] < 24 * took[0] + 0.1
