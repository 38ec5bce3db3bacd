"""Secret scans keep every literal of an expression, however long or wrapped."""

import pytest

from foldlens.llm import secrets


def literals(text):
    return [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in secrets.scan(text)["spans"].split(",") if s) if k == "literal"]


def test_long_expressions():
    parts = [f"aB{i:03d}" for i in range(200)]
    text = "auth_secret_value = " + " + ".join(f'"{p}"' for p in parts)
    assert literals(text) == parts


@pytest.mark.parametrize(
    "text",
    [
        'client_secret_value =\n    "aB3x" + "9kQz7"', 'client_secret_value = "aB3x" +\n    "9kQz7"', 'client_secret_value = (\n  "aB3x"\n  "9kQz7"\n)', 'String clientSecretValue = "aB3x"\n    + "9kQz7";',
        'client_secret_value = ("aB3x" +\r\n  "9kQz7")', 'half = "9kQz7"\nclient_secret_value = (\n  "aB3x" +\n  half)', 'client_secret_value = \\\n  "aB3x" + \\\n  "9kQz7"',
    ],
)
def test_wrapped_expressions(text):
    assert sorted(literals(text)) == ["9kQz7", "aB3x"]


def test_next_line_is_no_value():
    assert literals('client_secret_value:\n  username: aB3x9kQz7w\n  "other": "x"\n') == []
    assert literals("client_secret_value =\nusername_or_so = 5") == []
    assert literals('client_secret_value =\n"some_names-9X" = 5') == []


def test_long_names():
    assert literals("secret_" + "n" * 200 + ' = "aB3x9kQz7w"') == ["aB3x9kQz7w"]
    assert literals('"secret' + " of them" * 40 + '": "aB3x9kQz7w"') == ["aB3x9kQz7w"]


def test_constants_that_use_each_other():
    # 2 ** 300 characters, and every literal still has its place once
    text = 'c0 = "aB3x9"\n' + "".join(f"c{i} = c{i - 1} + c{i - 1}\n" for i in range(1, 301)) + 'my_secret_value = c300 + "Qz7w"'
    assert literals(text) == ["aB3x9", "Qz7w"]


def test_values_add_up():
    def plain(text):
        if len(text) < secrets.MIN_LITERAL or secrets.PLACEHOLDER.match(text) or " " in text.strip():
            return 0.0
        return None

    for parts in (["xxxx", "xxxxx"], ["<" + "a" * 50, "b" * 40 + ">"], ["x" * 40, "y", "x" * 40], [" a", "B", "cdefgh "], ["  ", "  ", "abc", " ", "defgh"], ["yo", "ur_key_here"], [" " * 5, " " * 5], ["*" * 50, "*" * 30]):
        value = secrets.Value()
        for p in parts:
            value.add(secrets.Value(p))
        assert value.length == len("".join(parts))
        want = plain("".join(parts))
        assert value.score() == secrets.Value("".join(parts)).score()
        assert want is None or value.score() == want
