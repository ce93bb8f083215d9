"""Token operators against the libraries they must agree with, and secret scans against plain searches."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from tidegrid.llm import bpe, secrets, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = "aAbsStTrREvVlLmdD'''\"  \n\t.!?1²½éßÉΣσÅİſK漢字🙂́\x1c\x85\xa0 \U00011de0"
EXAMPLES = [None, "", " ", "\n\n", "we'll they're 'sup 'rex 'lx 'l 'll 've'v x's's", "e\ńx", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>",
            "<|endoftext|>", "x" * 5000, " " * 3000, "漢" * 2000, "Ünïcode ΑΣ ΑΣΑ", "0123 ½ ²", "\0 \0\0"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return EXAMPLES + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["word " * 40_000]


@pytest.fixture
def docs(spark, texts):
    """Rows with clashing columns, repeated and null ids."""
    rows = [(i, t, "x", -1, "y", [1]) for i, t in enumerate(texts)] + [(3, texts[3], "x", -1, "y", [1]), (None, "null id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, n_bytes int, ids_sha256 string, ids array<int>")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_codec_equals_library(spark, docs):
    t = Tokenizer.from_file(BYTE)
    got = bpe.round_trip(docs, BYTE).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.count() - 1
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)))), r.text
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_encode_and_decode_are_a_round_trip(spark, docs):
    back = bpe.decode(bpe.encode(docs.drop("ids"), BYTE), BYTE)
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.encode(docs.limit(0), BYTE).count() == 0


def test_decode_any_ids():
    t, c, r = Tokenizer.from_file(BYTE), bpe.Codec(open(BYTE).read()), random.Random(2)
    for _ in range(500):
        ids = [r.randint(0, 50256) for _ in range(12)]
        assert c.decode(ids) == t.decode(ids, skip_special_tokens=False)
    assert c.decode([-1, 10**6]) == ""


def test_pieces_of_ascii_and_other_texts():
    """ASCII texts take a plain pattern of their own; both patterns split as the library's does, at every control character and contraction."""
    t, c, r = Tokenizer.from_file(BYTE), bpe.Codec(open(BYTE).read()), random.Random(4)
    theirs = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    plain = [*map(chr, range(128)), *("''' \n\tsstremvlld" * 3)]
    for letters in (plain, [*plain, *"éßÉ中٣½\xa0 \x85　😀"]):
        for _ in range(3000):
            text = "".join(r.choices(letters, k=r.randrange(1, 24)))
            assert c.pieces(text) == theirs.findall(text)
            if text.isascii():
                assert c.ascii_words.findall(text) == c.words.findall(text)
            assert c.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_merge_queue_equals_repeated_best_pair():
    c = bpe.Codec(open(BYTE).read()).merges
    for word in (b"aaaaaaaaaaab", b"mississippi", b"  the", bytes(range(256)), b"abababababa" * 30):
        ids = [c.first[b] for b in word]
        while True:
            ranks = [c.rank.get(a << 32 | b, 1 << 40) for a, b in zip(ids, ids[1:])]
            if not ranks or min(ranks) == 1 << 40:
                break
            i = ranks.index(min(ranks))
            ids[i:i + 2] = [c.made[ranks[i]]]
        assert c.encode(word) == ids


def test_counts_equal_library(spark, docs):
    t = Tokenizer.from_file(WORD)
    got = token_counts.count(docs, WORD, limit=5000).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.count() - 1
    for r in got:
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 5000), r.text
    assert token_counts.count(docs.limit(0), WORD).count() == 0


def test_state_maps_compose_to_the_sequential_run():
    import numpy as np

    to, emits = token_counts.transducer()
    classes = np.random.default_rng(3).integers(0, 11, 5000).astype(np.uint8)
    state, want = token_counts.BETWEEN, []
    for c in classes:
        want.append(emits[state, c])
        state = to[state, c]
    for chunk in (1, 7, 256, 10_000):
        said, exit_state = token_counts.emissions(classes, to, emits, chunk=chunk)
        assert said.tolist() == want and exit_state == state
    first, middle = token_counts.emissions(classes[:1234], to, emits)
    assert first.tolist() + token_counts.emissions(classes[1234:], to, emits, middle)[0].tolist() == want


KEY = "0123456789abcdef" * 2
SECRETS = [
    None, "", "password=hunter22 and token: short", f'api_key = "{KEY}"', f"AKIA{'A' * 15}", f"AKIA{'A' * 16} AKIAAKIA{'B' * 20}",
    f"x{KEY}y {KEY[:23]}", "PASSWORD:'abcdef' secret=abc secret=abcdefg", "tokenſ=abcdefg paſſword=abcdefgh toKen=abcdefgh", "漢字 passwd: 漢 passwd:abc123 🙂 token=aaaaaaa",
    "-----BEGIN RSA PRIVATE KEY-----\nAbC+/=\n-----END RSA PRIVATE KEY-----", f"ghp_{'a1' * 20}", "https://me:pa55word@example.com/x",
    "secret=secret=abcdefgh", "a" * 30, "plain words only. " * 5000 + "token=abcdef1",
]


def brute(text):
    """The base rules as they are stated."""
    rules = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))
    found = [(m.start(), n, m.end(), k) for n, (k, p, g, least) in enumerate(rules) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_secrets_equal_plain_search(spark):
    r = random.Random(9)
    noise = ["".join(r.choice(["token", "=", ":", " ", "secret", "abcdef", "AKIA", "ABCDEFGH12345678", "0a1b2c3d", "'", "é", "api_key", "passwd"])
                     for _ in range(r.randint(1, 14))) for _ in range(1500)]
    texts = SECRETS + noise
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, Secrets string").repartition(3)
    for row in secrets.digest(secrets.find(docs)).collect():
        want = brute(texts[row.doc_id])
        base = [s for s in row.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert base == want
        assert row.base_sha256 == sha(",".join(want))
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
    assert secrets.find(docs.limit(0)).count() == 0


def test_added_rules_and_redaction(spark):
    rows = [(i, t, "kept") for i, t in enumerate(SECRETS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mask string")
    spans = {r.doc_id: r.spans for r in secrets.digest(secrets.find(docs)).collect()}
    assert "private_key:0:" in spans[10] and "forge_token" in spans[11] and "url_password" in spans[12]
    out = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert all(r.mask == "kept" for r in out.values())
    assert out[0].text is None and out[1].text == "" and out[2].text.startswith("[REDACTED] and token")
    for i, t in enumerate(SECRETS):
        assert not [s for s in brute(out[i].text)] and (out[i].text == t or "[REDACTED]" in out[i].text)


def test_queries_never_lose_a_match():
    """Every string a rule matches satisfies the rule's trigram query."""
    scanner = secrets.Scanner()
    for text in SECRETS[2:]:
        postings = scanner.index([text.encode()])
        for rule, expression, query in scanner.rules:
            if expression.search(text):
                assert scanner.candidates(query, postings, 1).tolist() == [0], rule.kind
    assert secrets.trigram_query(secrets.BASE[2]) is True
    assert secrets.trigram_query(secrets.BASE[1]) == ("and", ("aki", "kia"))


def test_stale_entries_cost_no_lookup():
    """Only new neighbours are looked up: the first pairs once, and two at most for each merge."""
    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)}
    pairs = [("a", "a"), ("aa", "aa"), ("aaaa", "a"), ("b", "a"), ("a", "b"), ("aa", "b")]
    for a, b in pairs:
        vocab[a + b] = len(vocab)
    merges = bpe.Merges(vocab, pairs)
    merges.rank = Counted(merges.rank)
    for word in (b"a" * 40, b"ab" * 20, b"aab" * 13 + b"c", b"c"):
        merges.rank.asked = 0
        ids = merges.encode(word)
        assert merges.rank.asked <= len(word) - 1 + 2 * (len(word) - len(ids))
        text = list(word.decode())
        for a, b in pairs:  # the pair of the lowest rank first, from the left
            i = 0
            while i < len(text) - 1:
                if (text[i], text[i + 1]) == (a, b):
                    text[i:i + 2] = [a + b]
                i += 1
        assert ids == [vocab[x] for x in text]
