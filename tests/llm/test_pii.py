import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.llm import pii
from gridweave.llm.queries import op5_pii

SF = "/root/testdata/sf0.01"


def brute(text):
    """The base kinds straight from their patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ 0125()é\n", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute(text)


def test_checks_and_context():
    assert [s[:3] for s in pii.find_spans("4111 1111 1111 1111 4111 1111 1111 1112")] == []  # one match of 32 digits
    assert [s[0] for s in pii.find_spans("x 4111-1111-1111-1111, y")] == ["card"]
    assert [s[0] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32.")] == ["iban"]
    assert pii.find_spans("IBAN GB83 WEST 1234 5698 7654 32.") == []
    assert pii.find_spans("number 078-05-1120") == []
    assert [s[0] for s in pii.find_spans("my SSN is 078-05-1120")] == ["ssn"]
    assert pii.redact_text("é a@b.co, 1.2.3.4", pii.find_spans("é a@b.co, 1.2.3.4")) == "é [EMAIL], [IP]"
    assert pii.find_spans("1" * 300_000 + "@" * 1000) == []


def test_secrets_and_whole_word_context():
    digest = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert pii.find_spans(f'a token = "{digest}" b')[0][:3] == ("secret", 11, 51)
    assert [s[0] for s in pii.find_spans(f"the key is {digest}")] == ["secret"]
    assert pii.find_spans(f"monkey {digest} turnkeys") == [] and pii.find_spans("1" * 40 + " token " + "a" * 40) == []
    assert pii.redact_text("Password: hunter2024!", pii.find_spans("Password: hunter2024!")) == "Password: [SECRET]"
    assert pii.find_spans("the password: everything is a word") == []
    assert [s[3] for s in pii.find_spans("tip 1.2.3.4")] == [0.6] and [s[3] for s in pii.find_spans("ip 1.2.3.4")] == [0.6 + 0.3]


def test_query_equals_plain_patterns(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op5_pii(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        spans = brute(text or "")
        row, said = got[d], ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        every = row.spans.split(",") if row.spans else []
        assert every[: len(spans)] == (said.split(",") if said else []) and len(every) == len(row.scores.split(",") if row.scores else [])


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a@b.co", "z"), (3, "a@b.co", "z")], "doc_id long, text string, pii string")
    got = {tuple(r) for r in pii.digest(df).select("doc_id", "n_email", "spans").collect()}
    assert got == {(1, 0, ""), (2, 0, ""), (3, 1, "email:0:6")}
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == [None, "", "[EMAIL]", "[EMAIL]"]
    assert pii.detect(df).count() == 4 and pii.digest(df.limit(0)).count() == 0


def test_long_secrets_go_whole():
    for value in ("a1" * 150, "Zz9-" * 5000):
        text = f"set password = {value} now"
        assert pii.redact_text(text, pii.find_spans(text)) == "set password = [SECRET] now"
