"""Cases of the advice of round 1."""

import random
import string

from tribuna.llm import neardup, pagetext, secretscan


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_near_duplicates_with_one_whole_sketch(spark):
    """Texts of 49 to 64 shingles and the same with words appended, up to the threshold: every such pair is linked."""
    rnd, texts, hasher = random.Random(11), [], neardup.Hasher()
    for n in range(49, 65):
        for m in sorted({65, 75, 4 * n // 3}):
            if m > 4 * n // 3 or m < 65:
                continue
            for _ in range(4):
                words = [f"w{rnd.randrange(10**9)}" for _ in range(m + 4)]
                texts += [" ".join(words[: n + 4]), " ".join(words)]
    sets = [hasher.shingles(neardup.words_of(t)) for t in texts]
    assert all(neardup.reaches(neardup.common(a, b), len(a), len(b)) for a, b in zip(sets[::2], sets[1::2]))
    # what `needed` promises holds for the sketches of both
    for a, b in zip(sets[::2], sets[1::2]):
        assert neardup.common(a[: neardup.SKETCH], b[: neardup.SKETCH]) >= max(neardup.needed(len(a)), neardup.needed(len(b)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_secrets_after_equals_and_in_mixed_alphabets(spark):
    rnd = random.Random(5)
    letters = string.ascii_letters + string.digits
    draw = lambda n, chars=letters: "".join(rnd.choice(chars) for _ in range(n - 1)) + "7"
    values = [draw(n) for n in (36, 40, 64)]
    mixed = draw(60, letters + "+/-_") + "+/-_a1"
    texts = [f"GITHUB_PAT={values[0]}", f"export A_LONG_NAME_OF_A_VARIABLE_2={values[1]}\n", f"https://x.org/a?sig={values[2]}&n=1", f"see {mixed} there", f"blob={values[1]}== end"]
    texts.append("PATH_OF_IT=some-words/of_the/common-language/2020/and_other-words/again")
    got = {r.doc_id: r.spans for r in secretscan.scan_secrets(docs(spark, texts)).collect()}
    for i, value in enumerate([*values, mixed, values[1] + "=="]):
        start = texts[i].index(value)
        assert got[i] == f"random:{start}:{start + len(value)}", texts[i]
    assert got[5] == ""
    redacted = {r.doc_id: r.text for r in secretscan.redact_secrets(docs(spark, texts)).collect()}
    assert redacted[0] == "GITHUB_PAT=<redacted>" and redacted[2] == "https://x.org/a?sig=<redacted>&n=1"


def test_page_text_of_unclosed_elements():
    model = pagetext.fit()
    text = "A sentence of the article that is long enough to be read as what the page is about."
    body = f"<article><h1>A title of the page</h1><p>{text}</p><p>{text}</p></article>"
    whole = pagetext.main_text(f"<html><head><title>x</title></head><body>{body}</body></html>", model)
    assert whole.count(text) == 2
    for page in (
        f"<html><head><title>x</title><body>{body}</body></html>",
        f"<html><head><meta charset=x><script>a='<body>'</script><style>p {{}}</style>{body}</html>",
        f"<html><head><title>x</title>{body}",
        f"<html><head><title>x<body>{body}</body></html>",
        f"<html><head></head><body><div><button>Go</div>{body}</body></html>",
        f"<html><head></head><body><button>Go{body}</body></html>",
        f"<html><head></head><body><button>Go{body}<button>Stop</button></body></html>",
        f"<html><head></head><body><div><select><option>a<option>b</div>{body}</body></html>",
        f"<html><head></head><body><object><object>{body}<div><object>x</object></div></body></html>",
        f"<html><head></head><body><svg><path d='m'>{body}</body></html>",
        f"<html><head></head><body><noscript>on{body}</body></html>",
        f"<html><head></head><body><object>{body}<noscript>a</noscript><div><noscript>b</div></body></html>",
        f"<html><head></head><body>{body}<div><button><div>Go<p>there</div></button></div></body></html>",
        f"<html><head></head><body>{body}<div><svg><title>t</title><text>Go</text><svg/></svg></div></body></html>",
    ):
        assert pagetext.main_text(page, model) == whole, page
    # unclosed elements cost in proportion to the page
    for tag in ("button", "object", "noscript", "svg", "video"):
        assert len(pagetext.parse(f"<{tag}>x<i>y</i> " * 20_000 + f"</{tag}>" + body)) == 5
