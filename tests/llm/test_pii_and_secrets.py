import re

import numpy as np
import pytest
from test_corpus_operators import CLASHING, frame, odd_texts

from millrace.llm import pii, secret_scan

S = pii.Surrogates("key")


@pytest.mark.parametrize("n", [2, 3, 10, 97, 256, 1000])
def test_permutations_have_no_fixed_points(n):
    out = [S.permute(i, n, "t") for i in range(n)]
    assert sorted(out) == list(range(n)) and all(a != i for i, a in enumerate(out))


@pytest.mark.parametrize(
    "text",
    ["joe.doe42@mail8.example.com", "+1 (579) 555-6331", "4111 1111 1111 1111", "95.127.96.64", "DE89 3704 0044 0532 0130 00", "123-45-6789", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
)
def test_surrogates_keep_format(text):
    new, found = pii.replace(f"x {text} y", S)
    assert len(found) == 1 and text not in new
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)))
    if ":" not in text:
        assert shape(new) == shape(f"x {text} y")
    assert pii.replace(f"x {text} y", S)[0] == new and pii.replace(f"x {text} y", pii.Surrogates("other"))[0] != new
    assert pii.detect(new)


def test_checks_and_octets_hold():
    for i in range(200):
        body = f"4{i:014d}"
        new = pii.replace(body + str(pii.luhn(body)), S)[0]
        assert pii.luhn(new[:-1]) == int(new[-1])
        ip = pii.replace(f"{i % 256}.{i}.0.255", S)[0]
        assert all(0 <= int(x) <= 255 for x in ip.split("."))


def test_coreference_and_distinctness():
    a, b = pii.replace("Joe@Mail.com joe@mail.com +1 (579) 555-6331 +15795556331", S)[0], S.email("joe@mail.com")
    parts = a.split(" ")
    assert parts[0].lower() == parts[1] == b and re.sub(r"\D", "", "".join(parts[2:5])) == parts[5][1:]
    many = {S.of("ipv4", f"{a}.{b}.3.4") for a in range(10) for b in range(10)}
    assert len(many) == 100
    assert len({S.email(f"{a}{b}@mail.com") for a in "abcdefgh" for b in range(10)}) == 80


def test_names_keep_gender_and_script():
    new = pii.replace("Mrs. Anna Schmidt, Mr Peter, Госпожа Мария", S)[0]
    first, peter, maria = re.match(r"Mrs\. (\w+) \w+, Mr (\w+), Госпожа (\w+)$", new).groups()
    assert pii.GENDER_OF[first] == ("f", "LATIN") and first != "Anna"
    assert pii.GENDER_OF[peter] == ("m", "LATIN") and pii.GENDER_OF[maria] == ("f", "CYRILLIC")


@pytest.mark.parametrize(
    "text, name",
    [("Dr. John Fitzgerald Kennedy, x", "John Fitzgerald Kennedy"), ("Herr Hans-Peter Müller, x", "Hans-Peter Müller"), ("Mr. J. R. R. Tolkien, x", "J. R. R. Tolkien"), ("Mr O'Neil, x", "O'Neil"), ("Ms D'Angelo, x", "D'Angelo"), ("Mr Rip van der Berg came", "Rip van der Berg"), ("Herr Dr. Jones, x", "Jones"), ("Mrs. Smith's house", "Smith"), ("Mr and Mrs Smith, x", "Smith"), ("Dr 王伟, x", "王伟"), ("Dr. محمد علي, x", "محمد علي"), ("Dr राजेश कुमार, x", "राजेश कुमार"), ("Sra Ñúñez, x", "Ñúñez")],
)
def test_whole_names_go(text, name):
    new, found = pii.replace(text, S)
    assert [text[a:b] for a, b, *_ in found] == [name]
    assert not set(re.findall(r"[^\W\d_]{2,}", name)) - {"van", "der"} & set(re.findall(r"[^\W\d_]+", new))


@pytest.mark.parametrize("text", ["Dr Smith said hello", "Prof Müller and others came", "Frau Weber geht heim", "Mr Jones went home"])
def test_clean_words_after_a_name_stay(text):
    new, found = pii.replace(text, S)
    assert len(found) == 1 and new.split()[2:] == text.split()[2:] and new.split()[1] != text.split()[1]


def test_names_are_found_again_without_their_title():
    text = "Mr Smith went home. Smith was tired. John Smith left, Smithsonian stayed. Mrs. Anna van der Berg: Berg's den. Van life, a berg"
    new, found = pii.replace(text, S)
    names = [text[a:b] for a, b, *_ in found]
    assert names[:2] == ["Smith", "Smith"] and names[2].endswith("Smith") and names[3:] == ["Anna van der Berg", "Berg"]
    assert "Smith " not in new and "Smithsonian" in new and "a berg" in new and "Van life" in new
    assert len({e[4] for e in found if e[3] == "smith"}) == 1
    again, spans = pii.replace("Dr 王伟 来了。王伟 走了", S)
    assert len(spans) == 2 and "王伟" not in again


def brute_pii(texts, key):
    """Every span replaced one after another from the end, with the key that no two entities of all texts share a surrogate under."""
    for k in range(8):
        s = pii.Surrogates(key if not k else f"{key}#{k}")
        seen = {}
        for t in texts:
            for a, b, kind in pii.detect(t):
                norm = pii.canonical(kind, t[a:b])
                seen.setdefault((kind, s.of(kind, norm)), set()).add(norm)
        if all(len(v) == 1 for v in seen.values()):
            break
    out = []
    for t in texts:
        spans = pii.detect(t)
        for a, b, kind in reversed(spans):
            t = t[:a] + pii.dressed(kind, t[a:b], s.of(kind, pii.canonical(kind, t[a:b]))) + t[b:]
        out.append((t, len(spans)))
    return out


def test_pii_query_is_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = dict(zip(rows, brute_pii(list(rows.values()), pii.DEFAULT_KEY)))
    assert {r.doc_id: (r.text, r.n_entities) for r in pii.op2_pii(spark, "/root/testdata/sf0.01").collect()} == want


def test_secret_query_is_brute_force(spark, forest):
    """Every candidate of every whole text, one at a time."""
    got = {r.doc_id: (r.n_candidates, [(s.start, s.end) for s in r.secrets]) for r in secret_scan.op5_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = secret_scan.candidates(r.text)
        hits = [{"start": a, "end": b, "score": p} for a, b in spans if (p := float(forest.predict(np.array([secret_scan.features(r.text, a, b, r.source or "")]))[0])) >= secret_scan.THRESHOLD]
        assert got[r.doc_id] == (len(spans), [(s["start"], s["end"]) for s in secret_scan.outermost(hits)])


def test_every_script_has_other_letters():
    for script in ("王伟李娜张敏", "محمدعلي", "रजशकम", "김철수박영", "さとうけん", "ñçßøł", "ёйъьэ"):
        words = {a + b for a in script for b in script}
        got = {S.of("person", w) for w in words}
        assert len(got) == len(words) and all(S.of("person", w) != w for w in words)


@pytest.mark.parametrize("text", ["2001:db8::1", "::1", "fe80::1:2", "555.123.4567", "(030) 1234 567", "030 1234567", "06 12 34 56 78", "(555)123-4567"])
def test_short_addresses_and_national_phones(text):
    new, found = pii.replace(f"x {text}, y", S)
    assert len(found) == 1 and found[0][:2] == (2, 2 + len(text)) and text not in new and pii.detect(new)
    assert not pii.detect("std::vector 10:20:30 on 01-02-2024 12 and 01/02/2024 10:30")


def test_pii_on_odd_tables(spark):
    texts = odd_texts() + ["a.b@c.com 10.20.30.40", "a.b@c.com 4619646426088949", "version 1.2.3 at 10:20:30, 3.14, 2024-05-06"]
    df = frame(spark, texts, extra=[*CLASHING, "entities"])
    key = pii.checked_key(df, "k")
    out = {r.doc_id: r for r in pii.pseudonymise(df, key).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        if i not in (n - 3, n - 2):
            assert out[i].safe_text == t and not out[i].entities
    assert [e.kind for e in out[n - 3].entities] == ["email", "ipv4"] and out[n - 3].entities[0].surrogate == out[n - 2].entities[0].surrogate
    assert pii.collisions(pii.pseudonymise(df, key)) == 0
    assert pii.pseudonymise(frame(spark, []), "k").count() == 0


def test_key_is_redrawn_on_a_collision(spark, monkeypatch):
    df = frame(spark, ["a@b.com c@d.com"])
    told = iter([1, 1, 0])
    monkeypatch.setattr(pii, "collisions", lambda d: next(told))
    assert pii.checked_key(df, "k") == "k#2"


def test_planted_data_goes(spark):
    out = pii.op2_pii(spark, "/root/testdata/sf0.001").collect()
    before = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(before)
    for r in out:
        for m in re.finditer(r"[\w.]+@\w+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.])\d{16}(?!\w)|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])", before[r.doc_id]):
            assert m[0] not in r.text
        assert (r.text == before[r.doc_id]) == (r.n_entities == 0)


# Secrets.


@pytest.fixture(scope="module")
def forest():
    return secret_scan.train(secret_scan.labelled_findings())


def test_forest_on_unseen_findings(forest):
    rows = secret_scan.labelled_findings(1000, seed=123)
    y = np.array([r[4] for r in rows])
    p = forest.predict(np.array([secret_scan.features(t, a, b, path) for t, path, a, b, _ in rows]))
    assert ((p >= secret_scan.THRESHOLD) == y).mean() > 0.97
    assert (secret_scan.Forest([]).predict(np.zeros((3, 24))) == 0).all()
    assert len(secret_scan.features(*[rows[0][i] for i in (0, 2, 3)])) == len(secret_scan.NAMES)


def test_secrets_and_look_alikes(spark, forest):
    key = "AKIA" + "Q7RT2MZX9KLP4WVB"
    hits = [f"the {key} of", 'token = "a448b0667399ff1a7e901d2aa447171b1a97a303" et', "password=5197f409e51a76f6b0 x"]
    none = ["card 4619646426088949 x", "commit a448b0667399ff1a7e901d2aa447171b1a97a303", "id 123e4567-e89b-12d3-a456-426614174000", "mail joe.doe42@mail8.example.com", "from 192.168.100.200 on"]
    df = frame(spark, hits + none + odd_texts(), extra=[*CLASHING, "secrets", "n_candidates"])
    out = {r.doc_id: r for r in secret_scan.scan(df, forest, path="source").collect()}
    assert [len(out[i].secrets) for i in range(len(hits) + len(none))] == [1, 1, 1, 0, 0, 0, 0, 0]
    assert hits[0][out[0].secrets[0].start : out[0].secrets[0].end] == key
    assert all(0.5 <= s.score <= 1 for r in out.values() for s in r.secrets)
    assert out[len(hits) + len(none)].secrets == [] and secret_scan.scan(df.limit(0), forest).count() == 0


@pytest.mark.parametrize("value", ["hunter2", "correcthorsebatterystaple", "abcDEFghiJKLmnoPQRstu", "p@ssw0rd123456!", *["".join(np.random.default_rng(n).choice(list("abcdefghKLMNOPQRSTUV0123456789"), n)) for n in (513, 600, 1500)]])
def test_assigned_values_of_any_form_and_length(forest, value):
    text = f'x = 1; password = "{value}", y'
    at = text.index(value)
    assert (at, at + len(value)) in secret_scan.candidates(text)
    assert forest.predict(np.array([secret_scan.features(text, at, at + len(value))]))[0] >= secret_scan.THRESHOLD
    bare = f"password={value} x"
    assert (9, 9 + len(value)) in secret_scan.candidates(bare)


def test_harmless_assigned_values(forest):
    for text in ("password = self.password", "the key: nobody knew", "monkey: banana", "token = get_token()", 'password: "your-password"', "password=changeme"):
        spans = secret_scan.candidates(text)
        assert spans and (forest.predict(np.array([secret_scan.features(text, a, b) for a, b in spans])) < secret_scan.THRESHOLD).all()


def test_overlapping_secrets_count_once():
    spans = lambda *p: [{"start": a, "end": b, "score": 1.0} for a, b in p]
    assert secret_scan.outermost(spans((0, 5), (0, 9), (3, 9), (9, 12))) == spans((0, 9), (9, 12))
    assert [("a?key=1&password=hunter2"[a:b]) for a, b in secret_scan.candidates("a?key=1&password=hunter2")] == ["1", "hunter2"]


def test_planted_secrets_are_found(spark):
    got = {r.doc_id: r for r in secret_scan.op5_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want = {m.span(m.lastindex) for m in re.finditer(r'(AKIA[0-9A-Z]{16})|token = "([0-9a-f]{40})|password=([0-9a-f]{18})', r.text)}
        assert {(s.start, s.end) for s in got[r.doc_id].secrets} == want
