import random
import re
import time

from llm_data import EDGES, docs_of, words  # noqa: F401

from veilframe.llm.surrogates import _iban_check, detect, dressed, luhn, surrogate, surrogate_table, with_surrogates

KEY = b"test key"
TEXT = (
    "Mail Anna.B@Mail8.example.com, card 4337 1665 9846 4399 or 4337166598464399; +1 (625) 555-7196, again 1-625-555-7196? "
    'From 78.118.65.158 and 10.1.2.3. token = "0641917ea4e9feb9cda8" password=Abc12345xyz. SSN 123-45-6789. '
    "Mr. John Smith met Mrs. Mary Jones; Mr. Smith and Frau JONES left. Господин Иванов."
)


def test_values_are_found():
    found = {(m.type, m.value) for m in detect(TEXT)}
    assert found >= {
        ("email", "anna.b@mail8.example.com"),
        ("card", "4337166598464399"),
        ("phone", "6255557196"),
        ("ip", "78.118.65.158"),
        ("ip", "10.1.2.3"),
        ("secret", "0641917ea4e9feb9cda8"),
        ("secret", "Abc12345xyz"),
        ("ssn", "123456789"),
        ("given", "john"),
        ("given", "mary"),
        ("surname", "smith"),
        ("surname", "jones"),
        ("surname", "иванов"),
    }
    more = {(m.type, m.value) for m in detect("Name: Ana Lund, +49 30 1234567 or +442079460958.")}
    assert more == {("given", "ana"), ("surname", "lund"), ("phone", "301234567"), ("phone", "2079460958")}
    assert detect("Version 300.1.2.3 of mr nobody, 12 of 2020-10-10, GB00WEST12345698765432") == []


def test_surrogates_keep_type_and_format():
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
    for m in detect(TEXT):
        old = TEXT[m.start : m.end]
        new = dressed(old, m.type, surrogate(KEY, m.type, m.value))
        assert new.lower() != old.lower()
        if m.type in ("email", "card", "phone", "ssn"):
            assert shape(new) == shape(old)
        if m.type == "card":
            digits = re.sub(r"\D", "", new)
            assert luhn(digits) == luhn(m.value) and digits[0] == m.value[0]
        if m.type in ("surname", "given"):
            assert new.isupper() == old.isupper() and bool(re.search("[а-я]", new.lower())) == bool(re.search("[а-я]", m.value))
        if m.value == "10.1.2.3":
            assert new.startswith("10.")
        if m.value == "0641917ea4e9feb9cda8":
            assert re.fullmatch("[0-9a-f]{20}", new)
    assert surrogate(KEY, "given", "mary", gender="f")[-1] == "a"
    iban = surrogate(KEY, "iban", "GB82WEST12345698765432")
    assert iban[:2] == "GB" and iban[2:4] == _iban_check("GB", iban[4:])
    assert surrogate(b"other", "ssn", "123456789") != surrogate(KEY, "ssn", "123456789")


def test_no_collisions_where_space_is_tight(spark):
    values = [("ip", f"{a}.{b}.1.1") for a in range(1, 8) for b in range(1, 10)] + [("surname", f"n{k}") for k in range(800)]
    rows = surrogate_table(spark.createDataFrame(values, "type string, value string"), KEY).collect()
    assert {(r.type, r.value) for r in rows} == set(values)
    assert len({(r.type, r.surrogate) for r in rows}) == len(values)
    assert not {(r.type, r.surrogate) for r in rows} & set(values)


def test_whole_table(docs_of):
    r = random.Random(3)
    pairs = [*EDGES, (100, TEXT), (101, TEXT), (101, TEXT), (102, "a@b.cd " + words(r, 2000)), (None, "call 10.1.2.3"), (103, "no values: 12")]
    docs = docs_of(pairs)
    out = with_surrogates(docs, KEY)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "n_replaced"] and len(rows) == len(pairs)
    hit = {r.doc_id: r.text for r in rows if r.n_replaced}
    assert set(hit) == {100, 101, 102, None} and hit[100] == hit[101]
    for value in ("Anna.B", "4337 1665", "4337166598464399", "555-7196", "78.118.65.158", "10.1.2.3", "0641917e", "Abc12345", "Smith", "JONES", "Иванов"):
        assert value not in hit[100]
    names = re.search(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+) and Frau (\w+) left", hit[100])
    assert names[2] == names[5] and names[4].upper() == names[6]
    cards = re.search(r"card ([0-9 ]+) or (\d+);", hit[100])
    assert cards[1].replace(" ", "") == cards[2]
    same = sorted((r.doc_id or -1, r.text or "") for r in rows if not r.n_replaced)
    assert same == sorted((i or -1, t or "") for i, t in pairs if not detect(t or ""))
    again = {x.doc_id: x.text for x in with_surrogates(docs, KEY).collect() if x.n_replaced}
    assert again == hit
    assert with_surrogates(docs_of([]), KEY).count() == 0


def test_secrets_are_replaced_whole():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    for text, value in (
        ("secret=" + "aZ9" * 300 + " end", "aZ9" * 300),
        (f'token="{jwt}", next', jwt),
        ("password: p!a.ss#w0rd$ and more", "p!a.ss#w0rd$"),
        ("pwd='correct horse; battery' left", "correct horse; battery"),
        ("password=ab!cd@host.com!xyz.", "ab!cd@host.com!xyz"),
    ):
        assert [(m.type, m.value) for m in detect(text)] == [("secret", value)]
        assert text[(m := detect(text)[0]).start : m.end] == value
    assert not set("пароль") & set(surrogate(KEY, "secret", "пароль12"))
    assert surrogate(KEY, "secret", "!!!!!!!!", 5) != "!!!!!!!!"


def test_small_spaces_are_widened(spark):
    values = [("ip", f"192.168.{a}.{b}") for a in range(10) for b in range(10)]
    values += [("email", f"{c}@mail.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("email", f"joe@{c}.com") for c in "abcdefghijklmnop"]
    rows = surrogate_table(spark.createDataFrame(values, "type string, value string"), KEY).collect()
    assert {(r.type, r.value) for r in rows} == set(values) and len(rows) == len(values)
    assert len({(r.type, r.surrogate) for r in rows}) == len(values) and not {(r.type, r.surrogate) for r in rows} & set(values)
    assert all(r.surrogate.startswith(("192.168.", "10.")) for r in rows if r.type == "ip")
    domains = {(r.value.split("@")[1], r.surrogate.split("@")[1]) for r in rows if r.type == "email"}
    assert len(domains) == len({d for d, _ in domains}) == len({n for _, n in domains}) == 17
    assert not {d for d, _ in domains} & {n for _, n in domains}
    assert dressed("A.b@C.com", "email", "x.yz@qr.com") == "X.yz@Qr.com"
    assert re.fullmatch("[α-ω]+", surrogate(KEY, "surname", "παπάς"))


def brute_detect_mail_and_ip(text):
    """Mail addresses and IPv4 addresses by splitting at spaces, without patterns."""
    found = []
    for word in text.split(" "):
        host = word.partition("@")[2]
        if word.count("@") == 1 and word[0].isalnum() and "." in host:
            found.append(("email", word.lower()))
        elif word.count(".") == 3 and all(x.isdigit() and int(x) < 256 for x in word.split(".")):
            found.append(("ip", word))
    return found


def test_detection_against_brute_force():
    r = random.Random(5)
    parts = [lambda: f"{words(r, 1)}{r.randrange(99)}@{words(r, 1)}.org", lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: words(r, 2)]
    for _ in range(200):
        text = " ".join(r.choice(parts)() for _ in range(r.randrange(12)))
        assert [(m.type, m.value) for m in detect(text)] == brute_detect_mail_and_ip(text)


def test_brute_force_replacement(docs_of):
    """Whole table against a replacer that goes value by value through a dictionary."""
    r = random.Random(6)
    pairs = [(k, " ".join(r.choice(["a%d@b%d.net", "10.%d.%d.7", "word%d or%d"]) % (r.randrange(5), r.randrange(5)) for _ in range(9))) for k in range(40)]
    out = {x.doc_id: x.text for x in with_surrogates(docs_of(pairs), KEY).collect()}
    known = {}
    for k, text in pairs:
        old, new = text.split(" "), out[k].split(" ")
        assert len(old) == len(new)
        for a, b in zip(old, new):
            if "@" in a or a.count(".") == 3:
                assert known.setdefault(a, b) == b and a != b
            else:
                assert a == b
    assert len(set(known.values())) == len(known) and not set(known.values()) & set(known)


def test_one_person_one_name(docs_of):
    texts = ["Mr. John Smith came. Later Smith left, and SMITH's dog; Name: John Jones, Dr. John Smith. smith works.", "Mrs. Ana Lund", "Name: Ana Lund", "Smith and John"]
    out = {x.doc_id: x.text for x in with_surrogates(docs_of(list(enumerate(texts))), KEY).collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Later (\w+) left, and (\w+)'s dog; Name: (\w+) (\w+), Dr\. (\w+) (\w+)\. smith works\.", out[0])
    assert m[1] == m[5] == m[7] != "John" and m[2] == m[3] == m[8] == m[4].capitalize() != "Smith" and m[6] not in ("Jones", m[2])
    assert out[1].removeprefix("Mrs. ") == out[2].removeprefix("Name: ") and out[1].split()[1].endswith("a")
    assert out[3] == texts[3]  # no title in the text


def test_one_number_however_written(docs_of):
    forms = ["+1 (625) 555-7196", "625-555-7196", "1-625-555-7196", "+49 30 1234567", "030 123 4567", "+33 30 123 4567"]
    new = [x.text for x in with_surrogates(docs_of(list(enumerate(forms))), KEY).orderBy("doc_id").collect()]
    digits = [re.sub(r"\D", "", x) for x in new]
    assert digits[0] == "1" + digits[1] == digits[2] and digits[0][1:] != "6255557196"
    assert digits[3].removeprefix("49") == digits[4].removeprefix("0") == digits[5].removeprefix("33") != "301234567"
    assert [re.sub(r"\d", "0", x) for x in new] == [re.sub(r"\d", "0", x) for x in forms]


def test_more_scripts_and_addresses(docs_of):
    assert {(m.type, m.value) for m in detect("感谢王伟先生和李小芳女士。姓名：陈明")} == {("han_name", "王伟"), ("han_name", "李小芳"), ("han_name", "陈明")}
    assert [(m.type, m.value) for m in detect("قال السيد محمد شيئا")] == [("surname", "محمد")]
    assert re.fullmatch("[\u0600-\u06ff]+", surrogate(KEY, "surname", "محمد"))
    assert len(surrogate(KEY, "han_name", "王伟", gender="m")) == 2
    for text, value in (("at 2001:db8::8a2e:370:7334, ok", "2001:db8::8a2e:370:7334"), ("FE80::1:2:3 end", "fe80::1:2:3")):
        assert [(m.type, m.value) for m in detect(text)] == [("ipv6", value)]
        new = dressed(text[(m := detect(text)[0]).start : m.end], "ipv6", surrogate(KEY, "ipv6", value))
        assert detect(f" {new} ")[0].value == new.lower() != value
    assert detect("at 12:30:45 std::cout a::b 1:2:3") == []
    out = with_surrogates(docs_of([(1, "王伟先生, 王伟先生, السيدة مريم, fe80::1:2:3")]), KEY).first()
    assert out.n_replaced == 4 and not re.search("王伟|مريم|:1:2:3", out.text) and out.text[:4] == out.text[6:10]


def test_long_address_list():
    text = "; ".join(f"user{k}@host{k % 97}.example.org" for k in range(100_000))
    start = time.monotonic()
    assert len(detect(text)) == 100_000 and time.monotonic() - start < 20
    text = "Mr. " + " ".join(f"Anna{'bcdefghij'[k % 9]}" for k in range(100_000))
    start = time.monotonic()
    assert len(detect(text)) > 20_000 and time.monotonic() - start < 20
