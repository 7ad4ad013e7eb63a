import hashlib
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from corpus import documents, frame  # noqa: E402

from thicket.llm import secrets  # noqa: E402

KEY = "AKIA" + "ABCDEFGH12345678"
HEX = "0123456789abcdef01234567"
TEXTS = [
    'password = "hunter22"', "PASSWD:abc", "my api_key='Zx9-_=/+.a'  and APIKEY : 12345", f"é {KEY} {KEY[:-1]} {HEX}{HEX} {HEX[:-1]}", "token=token=abcdefgh", 'secret": "abcdef"', f"TOKEN={HEX}", "", None, "key = value : x", "paſſword = abcdefgh", "toKen=abcdefgh",
    "password\n= abcdefg", f"AKIA{KEY}", "secret:secret:secret", "token == abcdefghij", "x" * 300000 + f" secret={HEX} " + "y" * 100,
]


def brute(text):
    text = text or ""
    kinds = (("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    out = []
    for k, (name, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if (len(m[2]) >= 6) if name == "assign" else len(m[0]) >= (20 if name == "access" else 24):
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(None if r[0] is None else r[0] + 100_000, r[1], None, None, None) for r in documents()]
    got = secrets.scan_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), hashlib.sha256(",".join(brute(r[1])).encode()).hexdigest(), *(sum(x.startswith(k) for x in brute(r[1])) for k in ("assign", "access", "hex"))) for r in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want
    for r in got:
        if r.doc_id is not None and r.doc_id < len(TEXTS):
            assert set(brute(TEXTS[r.doc_id])) <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize(
    "text,found",
    [
        ('k = "s8Jd72hQpZ1x"\nadmin_pwd = k', ["s8Jd72hQpZ1x"]),
        ('db_credential => "Tr0ub4dor&3xyz"', ["Tr0ub4dor&3xyz"]),
        ("privateKey: 'aZ9kLq83mN2pXw7v'", ["aZ9kLq83mN2pXw7v"]),
        ('a = "Qw8rTy2u"\nsigningKey = a + "Zx5cVb9n"', ["Qw8rTy2u", "Zx5cVb9n"]),
        ('title = "s8Jd72hQpZ1x"', []),
        ('pwd = "changeme"', []),
        ("pwd = ${PWD_FROM_VAULT}", []),
        ("the key: it was found in the garden", []),
        ('privateKey = """\n  aZ9kLq83mN2p\n  Xw7vTq5rYb1c\n"""', ["aZ9kLq83mN2p", "Xw7vTq5rYb1c"]),
        ("auth_token = '''s8Jd72hQpZ1x'''", ["s8Jd72hQpZ1x"]),
        ("db_pwd = `s8Jd72hQpZ1x`", ["s8Jd72hQpZ1x"]),
        ("data:\n  privateKey: |\n    aZ9kLq83mN2p\n    Xw7v=Tq5rYb1c\n\n  title: x", ["aZ9kLq83mN2p", "Xw7v=Tq5rYb1c"]),
        ('def f():\n    k = "s8Jd72hQpZ1x"\ndef g():\n    pass\nadmin_pwd = k', []),
        ('k = "s8Jd72hQpZ1x"\ndef f():\n    admin_pwd = k', ["s8Jd72hQpZ1x"]),
        ('k = "s8Jd72hQpZ1x"\nk = "plain words"\nadmin_pwd = k', []),
    ],
)
def test_lexer(text, found):
    base, every = secrets.all_spans(text)
    assert [text[a:b] for a, k, b in every if k == 3] == found


def test_lexer_on_labelled_lines():
    """Credentials that no fixed pattern finds, among settings that look like them: each is found, and nothing else."""
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n)) + rng.choice("A7") + rng.choice("b9")
    true = ["dbPwd = '{}'", 'client_credential: "{}"', "SIGNING_KEY={}", "private_key => '{}'", 'x = "{}"\n{} = x']
    false = ["title = '{}'", 'path: "/usr/share/{}"', "count = 12345678", "color: '#a1b2c3'", "pwd = ${{VAULT_{}}}", "monkey = '{}'"]
    for _ in range(200):
        secret, lines = word(rng.randint(12, 24)), []
        lines += [rng.choice(false).format(word(12)) for _ in range(3)]
        lines.insert(rng.randrange(4), rng.choice(true).format(secret, "adminPwd"))
        text = "\n".join(lines)
        base, every = secrets.all_spans(text)
        assert not [x for x in base if x[1] == 0] and [text[a:b] for a, k, b in every if k == 3] == [secret]


def test_many_spans_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        text = "".join(f"token = abcdef{i}\nsetting_{i}: value\nadminPwd = 'Zx9qLm{i}Rt'\n" for i in range(n))
        began = time.process_time()
        base, every = secrets.all_spans(text)
        took.append(time.process_time() - began)
        assert len(base) == n and len(every) == 2 * n
    assert took[1] < 9 * took[0]
    # blocks within blocks, and quotes that never end
    deep = "".join(" " * (i % 300) + f"k{i}: |\n" for i in range(6000)) + "x = \"\"\"" * 6000
    began = time.process_time()
    secrets.all_spans(deep)
    assert time.process_time() - began < 20


def test_redaction(spark):
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    df = frame(spark, rows)
    out = secrets.redact_secrets(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == 'password = "[SECRET]"' and got[0].n_chars == len(got[0].text) and got[8].text is None and got[9].text == TEXTS[9]
    for i, t in enumerate(TEXTS):
        assert not any(x.split(":")[0] in ("hex", "access") for x in brute(got[i].text))
        if t and not secrets.all_spans(t)[1]:
            assert got[i].text == t


def test_long_sums():
    """Every part of a sum counts, however many there are, and so do constants that are added up again and again."""
    parts = [f"{c}{i}" for i in range(60) for c in "aQz"]
    text = "db_credential = " + " + ".join(f'"{p}"' for p in parts)
    assert [text[a:b] for a, k, b in secrets.all_spans(text)[1]] == parts
    assert secrets.redacted(text, "#") == "db_credential = " + " + ".join(['"#"'] * len(parts))
    text = 'a0 = "Zx9q7"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(2000)) + "adminPwd = a2000"
    assert [text[a:b] for a, k, b in secrets.lexed_spans(text)] == ["Zx9q7"]
    text = 'b0 = "Zx9q"\n' + "".join(f'b{i + 1} = b{i} + "{i}k"\n' for i in range(3000)) + "adminPwd = b3000"
    assert len(secrets.lexed_spans(text)) == 3001


@pytest.mark.parametrize(
    "text,found",
    [
        ('db_pwd = "correcthorsebattery"', ["correcthorsebattery"]),
        ('passphrase = "qwertyuiopasdfgh"', ["qwertyuiopasdfgh"]),
        ('user_credential = "8429107356284917"', ["8429107356284917"]),
        ('pwd = "aaaaaaaaaaaaaaaaaaaa"', []),
        ('cookie = "correcthorsebattery"', []),
        ('a = "Qw8r"\nadminPwd = a + a + a', ["Qw8r"]),
    ],
)
def test_one_kind_of_characters(text, found):
    assert [text[a:b] for a, k, b in secrets.lexed_spans(text)] == found
