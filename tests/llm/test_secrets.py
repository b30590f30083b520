import hashlib
import random
import re

from corvane.llm.io import table
from corvane.llm.secrets import ROLE, base_spans, find_secrets, joined, linked_spans, op1_secret_scans, redact, weak_parts


def test_base_patterns_and_limits():
    t = 'x Password : "abcdefghijkl" AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef 0123456789abcde token=short'
    assert joined(base_spans(t)) == "assign:2:26,access:28:46,hex:57:73"


def test_matches_do_not_overlap_and_failing_ones_are_dropped():
    assert base_spans('password: token = "abcdefghijklmnop"') == []
    assert joined(base_spans("token=secret=abcdefghijkl")) == "assign:0:25"


def test_positions_are_code_points_and_case_is_ascii():
    assert base_spans("äöü token=abcdefghijkl") == [(4, 22, "assign")]
    assert base_spans("paſſword=abcdefghijkl") == []


def test_weak_parts_need_complements():
    weak = "Ab3dEf6hIj9lMn2pQr5tUv"
    alone = f"note {weak} end"
    assert linked_spans(alone, base_spans(alone), 200) == []
    both = f"user = alice\nkey {weak}"
    assert {k for *_, k in linked_spans(both, base_spans(both), 200)} == {"identity", "opaque"}
    apart = f"user = alice\n\nkey {weak}"
    assert linked_spans(apart, base_spans(apart), 200) == []
    far = "user = alice " + "x " * 300 + weak
    assert linked_spans(far, base_spans(far), 200) == []
    three = f"host = db.example.com user = alice {weak}"
    assert "endpoint" in {k for *_, k in linked_spans(three, base_spans(three), 200)}


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a", "c"), (2, "", "a", "c"), (3, "token=abcdefghijkl", "a", "c"), (3, "token=abcdefghijkl", "a", "c"), (None, "w " * 50000 + "AKIA" + "A" * 20, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, findings string, kind string")
    out = find_secrets(df).collect()
    assert [len(r.findings) for r in out] == [0, 0, 1, 1, 1] and out[4].findings[0].start == 100000
    assert find_secrets(df.limit(0)).count() == 0
    cut = redact(find_secrets(df)).filter("doc_id = 3").first()
    assert cut.text == "[secret]"


def test_short_values_one_case_tokens_and_long_parts():
    kinds = lambda t: {k: t[s:e] for s, e, k in linked_spans(t, base_spans(t), 200)}
    assert kinds("user=admin password=hunter2 host=db1.local") == {"identity": "admin", "short": "password=hunter2", "endpoint": "host=db1.local"}
    assert kinds("password=hunter2 host=db1.local") == {}
    low, long = "k3j9x0q7w2m5z8y1t6r4", "Ab3dEf6hIjk" * 8 + "=="
    assert kinds(f"login: bob {low}") == {"identity": "bob", "opaque": low}
    assert kinds(f"login: bob {long}") == {"identity": "bob", "opaque": long}
    name, url = "n" * 100, "https://db.example.com/" + "p" * 300
    assert kinds(f"user={name} {low} {url}") == {"identity": name, "opaque": low, "endpoint": url}
    assert kinds(f"user=svc;AccountKey={long}") == {"identity": "svc", "opaque": long}


def slow_base(text):
    """The contract word by word, without hints and shortcuts."""
    found = []
    for kind, order, pattern, group, least in (
        ("assign", 0, r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", 2, r"[0-9a-f]+", 0, 16),
    ):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def slow_links(text, base, reach):
    """All pairs of parts."""
    weak = [w for w in weak_parts(text) if w[2] == "endpoint" or not any(s < w[1] and w[0] < e for s, e, _ in base)]
    scope = lambda s: len([m for m in re.finditer(r"\n[ \t]*\n", text) if m.start() < s])
    needs = {"identity": ("secret",), "opaque": ("identity",), "short": ("identity",), "endpoint": ("identity", "secret")}
    near = lambda w, role: any(
        ROLE[k] == role and (s, e) != w[:2] and scope(s) == scope(w[0]) and s <= w[1] + reach and e >= w[0] - reach for s, e, k in base + weak
    )
    return [w for w in weak if all(near(w, role) for role in needs[w[2]])]


def test_all_documents_match_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    out = {r.doc_id: r for r in op1_secret_scans(spark, sf).collect()}
    assert out.keys() == docs.keys()
    for doc, text in docs.items():
        base = slow_base(text)
        links = slow_links(text, base, 200)
        r = out[doc]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex, r.n_linked) == tuple(sum(k == x for *_, x in base) for k in ("assign", "access", "hex")) + (len(links),)
        assert set(r.spans.split(",")) - {""} == {f"{k}:{s}:{e}" for s, e, k in base + links}


def test_links_of_random_parts_match_brute_force():
    rng = random.Random(6)
    words = ["user = alice", "login: bob2", "Ab3dEf6hIj9lMn2pQr5tUv", "password=hunter2", "host = db.example.com", "https://x.example.com/" + "p" * 90, "token=" + "q" * 60, "0123456789abcdef", "user = k3j9x0q7w2m5z8y1t6r4", "filler text", "\n", "\n\n", "s" * 30 + "1"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(2, 25)))
        base = base_spans(text)
        assert base == slow_base(text)
        for reach in (5, 40, 200):
            assert linked_spans(text, base, reach) == slow_links(text, base, reach)


def test_parts_that_share_a_span_or_hide_each_other():
    one, two = "Ab3dEf6hIj9lMn2pQr5tUv", "Zb3dEf6hIj9lMn2pQr5tUv"
    t = f"user = {one} then {two}"
    assert (t.index(two), len(t), "opaque") in linked_spans(t, base_spans(t), 200)
    t = "token=" + "q" * 300 + " 0123456789abcdef " + "x" * 150 + " user = alice"
    assert [k for *_, k in linked_spans(t, base_spans(t), 200)] == ["identity"]
