"""Labelled findings for the secret forest, made by rule: the label is what a finding was made as, whatever its features say.

A finding is a value with the text left and right of it. Values of secret kinds stand in credential places, or, where the
kind itself tells, anywhere. False ones are sums, ids, numbers, names and data in harmless places, and references,
placeholders and settings in credential places. A fixed number of them from a fixed seed; no corpus is read.
"""

from __future__ import annotations

import base64
import random
import uuid

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
LETTERS = UPPER + LOWER
ALNUM = LETTERS + DIGITS
CREDENTIALS = (
    "password passwd pwd db_password secret client_secret SECRET_KEY token auth_token access_token API_KEY apiKey api-key access_key "
    "aws_secret_access_key private_key auth credential credentials passphrase smtp.password X-Auth-Token refresh_token webhook_secret"
).split()
HARMLESS = (
    "commit sha1 sha256 md5 checksum etag digest version build release request_id trace-id uuid guid order_id invoice session_name color "
    "file path url host user_id count size port phone card isbn serial name title hash revision branch image_id file_hash doc content_md5"
).split()
SIGNS = ("=", " = ", ": ", ":", '="', ' = "', '": "', " = '", ": '", " => '", ":=")
PROSE = ("see ", "the ", "in ", "at ", "with number ", "under ", "from ", "called ", "marked ", "as ", "", "\n", "(", "ref ", "log: ")


def _any(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def _hex(rng: random.Random, *sizes: int) -> str:
    n = rng.choice(sizes)
    return _any(rng, "0123456789abcdef", n, n)


def _uuid(rng: random.Random) -> str:
    return str(uuid.UUID(int=rng.getrandbits(128)))


def _encoded(rng: random.Random, low: int, high: int) -> str:
    return base64.b64encode(rng.randbytes(rng.randint(low, high))).decode()


def _strong(rng: random.Random) -> str:
    value = list(_any(rng, ALNUM + "!@#%^*_-+?", 8, 20) + rng.choice(DIGITS) + rng.choice("!@#%*_-"))
    rng.shuffle(value)
    return "".join(value).lstrip("=-") or "p4ss!Word9"


def _phrase(rng: random.Random, words: list[str]) -> str:
    sep = rng.choice("-_.!")
    parts = [rng.choice(words) for _ in range(rng.randint(2, 4))]
    parts[rng.randrange(len(parts))] += str(rng.randrange(10, 9999))
    return sep.join(p.title() if rng.random() < 0.4 else p for p in parts)


def _prefixed(rng: random.Random) -> str:
    # Forms that providers give their keys.
    return rng.choice(
        (
            lambda: rng.choice(("AKIA", "ASIA")) + _any(rng, UPPER + DIGITS, 16, 16),
            lambda: rng.choice(("ghp_", "gho_", "ghs_")) + _any(rng, ALNUM, 36, 36),
            lambda: "github_pat_" + _any(rng, ALNUM + "_", 60, 82),
            lambda: "glpat-" + _any(rng, ALNUM + "-_", 20, 20),
            lambda: rng.choice(("xoxb-", "xoxp-", "xoxa-")) + "-".join((_any(rng, DIGITS, 11, 12), _any(rng, DIGITS, 11, 12), _any(rng, ALNUM, 24, 24))),
            lambda: rng.choice(("sk_live_", "rk_live_", "sk-", "sk-proj-")) + _any(rng, ALNUM, 24, 48),
            lambda: "AIza" + _any(rng, ALNUM + "-_", 35, 35),
            lambda: "eyJ" + ".".join((_any(rng, ALNUM, 20, 40), "eyJ" + _any(rng, ALNUM, 30, 80), _any(rng, ALNUM + "-_", 43, 43))),
            lambda: "npm_" + _any(rng, ALNUM, 36, 36),
        )
    )()


def _name(rng: random.Random, names: list[str]) -> str:
    name = rng.choice(names)
    name = rng.choice((name, name, name.upper(), name.lower(), name.title().replace("_", "")))
    return rng.choice(("", "", "", "my_", "prod.", "APP_", "config.", "user.")) + name


def _place(rng: random.Random, names: list[str]) -> tuple[str, str]:
    """Left and right of a value that is assigned to one of the names."""
    sign = rng.choice(SIGNS)
    name = _name(rng, names)
    left = rng.choice(("", "export ", "set ", "  ", '{"a": 1, "', "env: ", "const ", "- ")) + name + ('"' if sign == '": "' else "") + sign.removeprefix('"')
    quote = sign[-1] if sign[-1] in "\"'" else ""
    return left, quote + rng.choice(("", "\n", ";", ", ", " # set", "}", " and more"))


def _around(rng: random.Random, words: list[str]) -> tuple[str, str]:
    left = " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    return f"{left} {rng.choice(PROSE)}", rng.choice((" ", ". ", ", ", "\n", ")")) + rng.choice(words)


def made(words: list[str], each: int = 1500, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """`each` true and `each` false findings (value, left, right, label)."""
    rng = random.Random(seed)
    rows = []
    kinds = (
        lambda: _hex(rng, 16, 24, 32, 40, 64),
        lambda: _any(rng, ALNUM, 14, 48),
        lambda: _encoded(rng, 16, 48),
        lambda: _uuid(rng),
        lambda: _strong(rng),
        lambda: _phrase(rng, words),
        lambda: _any(rng, LOWER, 10, 28),
        lambda: _prefixed(rng),
    )
    for _ in range(each):
        roll = rng.random()
        if roll < 0.2:
            left, right = rng.choice((_place(rng, HARMLESS[-8:]), _around(rng, words), _around(rng, words)))
            rows.append((_prefixed(rng), left, right, 1))
        elif roll < 0.3:
            scheme = rng.choice(("Authorization: Bearer ", "authorization: Basic ", "-H 'Authorization: Bearer ", "bearer ", "Proxy-Authorization: Bearer "))
            rows.append((rng.choice((kinds[0], kinds[1], kinds[2], kinds[7]))(), scheme, rng.choice(("", "'", "\n", '"')), 1))
        else:
            left, right = _place(rng, CREDENTIALS)
            lead, _ = _around(rng, words)
            rows.append((rng.choice(kinds)(), rng.choice(("", lead, lead + "\n")) + left, right, 1))
    harmless = (
        lambda: _hex(rng, 32, 40, 64),
        lambda: _hex(rng, 7, 12, 32, 40),
        lambda: _uuid(rng),
        lambda: _any(rng, DIGITS, 12, 19),
        lambda: "-".join(_any(rng, DIGITS, 3, 4) for _ in range(rng.randint(3, 4))),
        lambda: f"{rng.choice(words)}_{rng.choice(words)}_{rng.choice(words)}{rng.randrange(100)}",
        lambda: rng.choice(words) + rng.choice(words).title() + rng.choice(words).title() + str(rng.randrange(1000)),
        lambda: f"v{rng.randrange(20)}-{rng.randrange(20)}-{rng.randrange(99)}-{rng.choice(words)}{rng.randrange(2100)}",
        lambda: f"2{rng.randrange(100, 999)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}T1{rng.randrange(9)}",
        lambda: f"/{rng.choice(words)}/{rng.choice(words)}/{rng.choice(words)}{rng.randrange(100)}",
        lambda: "iVBORw0KGgo" + _any(rng, ALNUM + "+/", 40, 120),
        lambda: f"{rng.choice(words)}-{rng.choice(words)}-{rng.choice(words)}-{rng.randrange(10_000)}",
    )
    stand_ins = (
        lambda: f"your_{rng.choice(words)}_here",
        lambda: f"<{rng.choice(words)}-{rng.choice(('password', 'token', 'key'))}>",
        lambda: rng.choice("xX*.0") * rng.randint(6, 24),
        lambda: rng.choice(("changeme", "change-me", "example", "placeholder", "dummy_value_1", "test1234", "TODO", "REPLACE_ME", "sample-token-123")),
        lambda: "${" + rng.choice(words).upper() + "_" + rng.choice(("KEY", "TOKEN", "PASSWORD")) + "}",
        lambda: rng.choice(("os.environ", "process.env.", "env.", "config.get", "getenv")) + rng.choice(("['KEY']", "API_KEY", "_TOKEN", "(name)")),
        lambda: rng.choice(("null", "None", "true", "false", "required", "optional", "string", "undefined", "hidden", "expired", "invalid", "reset", "forgotten")),
        lambda: rng.choice(words),
        lambda: f"example_{rng.choice(words)}_{rng.randrange(100)}",
        lambda: "{{ " + rng.choice(words) + " }}",
        lambda: "1234567890abcdef"[: rng.randint(8, 16)],
        lambda: str(rng.randrange(1, 9999)),
    )
    for _ in range(each):
        roll = rng.random()
        if roll < 0.35:
            left, right = _place(rng, HARMLESS)
            rows.append((rng.choice(harmless)(), left, right, 0))
        elif roll < 0.65:
            left, right = _around(rng, words)
            rows.append((rng.choice(harmless)(), left, right, 0))
        else:
            left, right = _place(rng, CREDENTIALS)
            rows.append((rng.choice(stand_ins)(), left, right, 0))
    return rows
