"""The battery of randomness tests against an independent version, and what it finds beside other strings."""

import math
import random
import re
import string

from tribuna.llm import secretscan as S

LETTERS = string.ascii_letters + string.digits


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def alphabet(body):
    for chars, letters in (
        ("0123456789abcdef", "0123456789abcdef"), (string.ascii_uppercase + "234567", string.ascii_uppercase + "234567"), (string.digits + string.ascii_lowercase, string.digits + string.ascii_lowercase),
        (string.digits + string.ascii_uppercase, string.digits + string.ascii_uppercase), (LETTERS, string.digits + string.ascii_uppercase + string.ascii_lowercase), (LETTERS + "+/", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
        (LETTERS + "-_", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"), (LETTERS + "+/-_", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_"),
    ):
        if set(body.lower() if letters == "0123456789abcdef" else body) <= set(chars):
            return letters
    return None


def plain(token):
    """(length, p-value of ordinary text) from the definitions, with the exact normal tail."""
    body = re.sub(r"^(?:[A-Za-z][A-Za-z0-9]{1,9}[_-]){1,2}(?=[A-Za-z0-9]{20,}$)", "", token.rstrip("="))
    letters = alphabet(body)
    if letters == "0123456789abcdef":
        classes, body = None, body.lower()
    else:
        classes = len(re.findall("[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+", body))
    k, n = len(letters), len(body)
    v = [letters.index(c) for c in body]
    expected = n / k
    chi = sum((v.count(i) - expected) ** 2 / expected for i in range(k))
    z = lambda x, d: ((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    high = [x >= k / 2 for x in v]
    runs, m = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    mu = 1 + 2 * m * (n - m) / n
    var = (mu - 1) * (mu - 2) / (n - 1)
    mean = sum(v) / n
    sq = sum((x - mean) ** 2 for x in v)
    lag = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    ps = [tail(z(chi, k - 1)), 2 * tail(abs(runs - mu) / math.sqrt(var)) if var > 0 else 0, 2 * tail(abs(lag / sq + 1 / n) * math.sqrt(n)) if sq else 0]
    even = 3 * min(ps)
    if k == 16:
        return n, even, 0.5**n
    away = n * max((0.055 if k < 62 else 0.042) * k - 1, 0.05)
    d = k - 1
    scale, d2 = (d + 2 * away) / (d + away), (d + away) ** 2 / (d + 2 * away)
    p1 = tail(-z(chi / scale, d2))
    p2 = tail((classes - 1 - 0.5 - 0.3 * (n - 1)) / math.sqrt(0.21 * (n - 1)))
    s = -math.log(max(p1, 1e-300)) - math.log(max(p2, 1e-300))
    return n, even, math.exp(-s) * (1 + s)


def tokens():
    rnd = random.Random(8)
    out = ["some-words/of_the/common-language/2020/again", "CamelCaseNameOfAThing2", "aaaaaaaaaaaaaaaaaaaa1", "DEADBEEFDEADBEEFDEAD12", "550e8400-e29b-41d4-a716-446655440000", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"]
    for chars in ("0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, LETTERS, LETTERS + "+/", LETTERS + "-_", LETTERS + "+/-_"):
        out += ["".join(rnd.choice(chars) for _ in range(n)) + "a1" * (chars == LETTERS) for n in (20, 24, 32, 40, 64, 120)]
    return [t for t in out if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]


def test_battery_against_plain(spark):
    df = spark.createDataFrame([(t,) for t in tokens()], "t string")
    for r in df.select("t", S._battery(df.t).alias("b")).collect():
        n, even, p = plain(r.t)
        assert r.b.n == n, r.t
        if even >= 1.3 * S.UNEVEN:
            assert abs(math.log(r.b.p) - math.log(p)) <= 0.05 * abs(math.log(p)) + 0.1, (r.t, r.b.p, p)
        elif even <= S.UNEVEN / 1.3:
            assert r.b.p == 1.0, (r.t, even)


def test_threshold_against_plain(spark):
    rnd = random.Random(2)
    strings = [(10 ** rnd.uniform(-9, 0), rnd.choice([20.0, 32.0, 50.0, 200.0])) for _ in range(400)]
    rows = [([(0, 1, p * S.USUAL / n, n) for p, n in strings[i : i + 40]],) for i in range(0, 400, 40)]
    got = S.threshold(spark.createDataFrame(rows, "weighed array<struct<start:bigint,end:bigint,q:double,n:double>>"))
    q, weight = sorted(p * S.USUAL / n for p, n in strings), sum(n for _, n in strings) / S.USUAL
    exact = max(x for i, x in enumerate(q, 1) if x * weight <= S.ALPHA * i)
    assert sum(x <= got for x in q) * S.ALPHA >= got * weight  # the rate holds at the step
    assert got >= exact * 2 ** (-2 / S.STEPS) or sum(got < x <= exact for x in q) <= 2  # and is not far below the exact step-up
    assert S.threshold(spark.createDataFrame([], "weighed array<struct<start:bigint,end:bigint,q:double,n:double>>")) == -1.0


def test_neighbours_change_nothing(spark):
    """Secrets are found alike alone and beside 200 ordinary strings, and hardly any of these is taken for one."""
    rnd = random.Random(6)
    syllables = ["ba", "con", "der", "es", "fi", "gran", "ho", "is", "ka", "lo", "men", "ni", "or", "per", "qua", "re", "son", "ta", "ur", "ve"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5)))

    def path():
        parts = [word() for _ in range(rnd.randrange(4, 7))]
        parts[rnd.randrange(len(parts))] = str(rnd.randrange(10, 10**4))
        return rnd.choice("-_/").join(parts) if rnd.random() < 0.7 else "".join(p.capitalize() for p in parts)

    rows, secrets = [], []
    for n, least in ((40, 0.95), (64, 1.0)):
        for m in (0, 10, 200):
            for _ in range(40):
                secret = "".join(rnd.choice(LETTERS) for _ in range(n - 2)) + "q7"
                rows.append((len(rows), " ".join([path() for _ in range(m // 2)] + [secret] + [path() for _ in range(m - m // 2)])))
                secrets.append((n, m, secret, least))
    got = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, false = {}, 0
    for (i, text), (n, m, secret, least) in zip(rows, secrets):
        at = text.index(secret)
        hit = ["random", str(at), str(at + n)] in got[i]
        found.setdefault((n, m, least), []).append(hit)
        false += len(got[i]) - hit
    for (n, m, least), hits in found.items():
        assert sum(hits) >= (least - 0.05) * len(hits), (n, m, sum(hits))
    assert false <= 0.002 * sum(m for _, m, _, _ in secrets)
