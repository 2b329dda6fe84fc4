import pytest
from pyspark.sql import functions as F

from umbraline.functions import replacements, tokens as T
from umbraline.functions import spans as S
from umbraline.operators import evals
from umbraline.operators import mask as M
from umbraline.operators import restore as R

# Tokens of this secret, as the format defines them.
SECRET = "golden-test-secret"
GOLDEN = {
    ("private_person", "김철수"): "{{OPF:PERSON:1w5p7jooa2mi3ozv}}",
    ("private_email", "alice@example.com"): "{{OPF:EMAIL:1w514s1guntf6zji}}",
    ("private_phone", "010-1234-5678"): "{{OPF:PHONE:1w54fcxggf29ytmu}}",
    ("rrn", "900101-1234567"): "{{OPF:RRN:1w55e3e0wtkko5nm}}",
}
MAIL = GOLDEN["private_email", "alice@example.com"]


@pytest.fixture(scope="module")
def vault(spark):
    rows = spark.createDataFrame([("s", i, t, c) for i, (c, t) in enumerate(GOLDEN)], "session_id string, o int, text string, c string")
    rows = rows.withColumn("sp", F.array(S.span(F.lit(0), F.col("text"), F.col("c"), 1.0)))
    return M.build_vault(M.mask(rows, M.MaskOptions(SECRET), spans="sp"), "session_id", "o").cache()


def restored(spark, vault, text, **options):
    df = spark.createDataFrame([(1, "s", text)], "id int, session_id string, text string")
    return R.restore(df, vault, SECRET, "id", options=R.RestoreOptions(**options)).first()


def test_golden(vault):
    assert {(r.category, r.text): r.token for r in vault.collect()} == GOLDEN
    key = T.token_key(SECRET)
    assert T.epoch(key) == "1w5"
    for (category, text), token in GOLDEN.items():
        assert T.format_token(token[6:].split(":")[0], T.token_hash(key, token[6:].split(":")[0], text)) == token
    with pytest.raises(ValueError):
        T.token_key("")
    with pytest.raises(TypeError):
        T.format_token("person", "x")


def test_canonical(spark):
    cases = {" a  b ": "a b", "a\u00a0\u3000b\ufeff": "a b", "a\tb\n": "a b", "A@x": "A@x", "\x1fa": "\x1fa", "": ""}
    for raw, want in cases.items():
        assert spark.range(1).select(T.canonical(F.lit(raw))).first()[0] == want


def test_roundtrip_and_first_spelling(spark):
    df = spark.createDataFrame([(1, "s", "mail a@b.co and a@b.co"), (2, "s", "card 4242 4242 4242 4242"), (3, "t", None), (4, "t", ""), (5, "s", "x@y.org {{OPF:EMAIL:1w514s1guntf6zji}}")], "id int, session_id string, text string")
    masked = M.mask(df, M.MaskOptions("k"))
    vault = M.build_vault(masked, "session_id", "id")
    assert not masked.filter("masked like '%a@b.co%' or masked like '%4242%'").count()
    back = {r.id: r for r in R.restore(masked.select("id", "session_id", "masked"), vault, "k", "id", "masked").collect()}
    want = {r.id: r.text for r in df.collect()}
    assert {k: r.restored for k, r in back.items()} == want
    assert back[5].unknown_token_count == 1 and back[5].foreign_count == 1
    again = M.mask(masked.select("id", F.col("masked").alias("text")), M.MaskOptions("k"))
    assert again.filter("masked != text").count() == 0


@pytest.mark.parametrize(
    ("text", "want", "counts"),
    [
        ("", "", {}),
        ("plain", "plain", {}),
        (f"to {MAIL}", "to alice@example.com", {"restored_count": 1}),
        (f"to {MAIL.lower()}", "to {{opf:email:1w514s1guntf6zji}}".replace("{{opf:email:1w514s1guntf6zji}}", "alice@example.com"), {"restored_count": 1, "partial_match_count": 1, "lenient_restored_count": 1}),
        (f"to {MAIL[:-2]} x", "to alice@example.com x", {"restored_count": 1, "lenient_restored_count": 1}),
        ("to {{OPF:EMAIL:1w514s1guntf6zjX}}", "to alice@example.com", {"restored_count": 1, "repaired_count": 1}),
        ("to {{OPF:EMAIL:1w514s1guntf6zj}}", "to alice@example.com", {"restored_count": 1, "repaired_count": 1}),
        ("to {OPF:EMAIL:1w514s1guntf6zji}", "to alice@example.com", {"restored_count": 1}),
        ("to {{OPF:EMAIL:1w5zzzzzzzzzzzzz}}", "to {{OPF:EMAIL:1w5zzzzzzzzzzzzz}}", {"unknown_token_count": 1, "dead_token_count": 1, "residual_token_count": 1}),
        ("to {{OPF:EMAIL:zzzzzzzzzzzzzzzz}}", "to {{OPF:EMAIL:zzzzzzzzzzzzzzzz}}", {"unknown_token_count": 1, "foreign_count": 1, "hallucinated_count": 1}),
        ("/a/{{OPF:EMAIL:zzzzzzzzzzzzzzzz}}/b", "/a/{{OPF:EMAIL:zzzzzzzzzzzzzzzz}}/b", {"path_skip_count": 1, "unknown_token_count": 0}),
        (f"/a/{MAIL}/b", "/a/alice@example.com/b", {"restored_count": 1}),
        ("{{OPF:CARD:1w514s1guntf6zji}}", "{{OPF:CARD:1w514s1guntf6zji}}", {"restored_count": 0, "unknown_token_count": 1}),
    ],
)
def test_restore(spark, vault, text, want, counts):
    r = restored(spark, vault, text)
    assert r.restored == want
    assert {k: r[k] for k in counts} == counts
    assert r.unknown_token_count == r.foreign_count + r.dead_token_count + r.ambiguous_count


def test_options(spark, vault):
    assert restored(spark, vault, MAIL.lower(), lenient=False).restored == MAIL.lower()
    assert restored(spark, vault, "{{OPF:EMAIL:1w514s1guntf6zjX}}", repair=False).dead_token_count in (0, 1)
    gone = restored(spark, vault, "{{OPF:EMAIL:zzzzzzzzzzzzzzzz}}", unknown="placeholder", origin="tool")
    assert gone.restored == "[UNRESTORABLE:EMAIL/foreign]" and gone.unminted_token_count == 1 and gone.hallucinated_count == 0
    assert restored(spark, vault, "/a/{{OPF:EMAIL:zzzzzzzzzzzzzzzz}}/b", skip_paths=False).path_skip_count == 0
    with pytest.raises(ValueError):
        R.RestoreOptions(unknown="guess")


def test_ambiguous(spark):
    vault = spark.createDataFrame([("s", "{{OPF:CARD:aaaaaaaaaaaaaaab}}", "CARD", "x", "aaaaaaaaaaaaaaab"), ("s", "{{OPF:CARD:aaaaaaaaaaaaaaac}}", "CARD", "y", "aaaaaaaaaaaaaaac")], "session_id string, token string, label string, text string, hash string")
    r = restored(spark, vault, "{{OPF:CARD:aaaaaaaaaaaaaaad}}")
    assert (r.ambiguous_count, r.restored_count) == (1, 0)


@pytest.mark.parametrize(("a", "b", "near"), [("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "acb", False), ("abc", "a", False)])
def test_one_edit(spark, a, b, near):
    x, y = F.lit(a), F.lit(b)
    met = F.size(F.array_intersect(R.deletions(x), R.deletions(y))) > 0
    got = spark.range(1).select(R.within_one_edit(x, y).alias("n"), met.alias("m")).first()
    assert got.n == near and (got.m or not near)


def test_paths():
    cases = [("C:\\x\\", "", True), ("/usr/", "", True), ("https://h/", "", True), ("./", "", True), ("a ", " b", False), ("x/", "", False), ("x/y/", "", True), ("", "please", False), ("x", "/y/z", True), ("x", "/y z/", False), ("", "/a/b", True)]
    for left, right, want in cases:
        assert R.PathTest(f"{left}T{right}")(len(left), R.leading(right, (False, 0))) is want, left


def test_rows_that_share_a_key(spark, vault):
    """Null and repeated keys, equal rows and null sessions: no row sees another one's entities."""
    phone = GOLDEN["private_phone", "010-1234-5678"]
    rows = [(1, "s", f"mail {MAIL}", "a"), (1, "s", f"{phone} is long before {MAIL}", "b"), (None, "s", f"x {phone}", "c"), (None, None, f"y {MAIL}", "d"), (1, "s", f"mail {MAIL}", "a"), (2, "s", None, "e")]
    df = spark.createDataFrame(rows, "id int, session_id string, text string, mark string").repartition(3)
    got = sorted((r.mark, r.restored) for r in R.restore(df, vault, SECRET, "id").collect())
    assert got == [
        ("a", "mail alice@example.com"), ("a", "mail alice@example.com"), ("b", "010-1234-5678 is long before alice@example.com"), ("c", "x 010-1234-5678"),
        ("d", f"y {MAIL}"), ("e", None),
    ]
    neutral = {r.mark: r.neutral for r in R.neutralise(df, vault, SECRET).collect()}
    assert neutral["d"] == "y [UNRESTORABLE:EMAIL/expired]" and neutral["b"] == rows[1][2]


def test_many_tokens_in_a_text(spark, vault):
    """Paths see what is already restored to their right; tokens without white space between them."""
    lost = "{{OPF:EMAIL:zzzzzzzzzzzzzzzz}}"
    text = " ".join([MAIL, f"/a/{lost}", lost, f"x{lost}/{MAIL}/y"] * 300)
    r = restored(spark, vault, text)
    assert r.restored == text.replace(MAIL, "alice@example.com")
    assert (r.restored_count, r.path_skip_count, r.unknown_token_count) == (600, 600, 300)


def test_salts_of_another_system():
    """Tokens under given salts, by the standard's own construction."""
    import hashlib
    import hmac

    other = T.Secret("k", b"salt one", b"salt two")
    first = hmac.new(b"salt one", b"k", hashlib.sha256).digest()
    assert T.token_key(other) == hmac.new(first, T.KEY_INFO + b"\x01", hashlib.sha256).digest()
    assert T.token_key(other) != T.token_key("k") == T.token_key(T.Secret("k")) and other == "k"


def test_synthetic_restoring_against_a_search(spark):
    """All values in one pass: the longest first, whole words only."""
    fix = lambda text, pairs: spark.createDataFrame([(text, [a for a, _ in pairs], [b for _, b in pairs])], "t string, v array<string>, o array<string>").select(R.synthetic_restorer()("t", "v", "o")).first()[0]
    pairs = [("Ann Lee", "X Y"), ("Ann", "Z"), ("", "no"), ("Lee", "L")]
    assert fix("Ann Lee, Ann; Lee Annie", pairs) == "X Y, Z; L Annie"
    assert fix("Ann Ann Lee AnnLee", pairs) == "Z X Y AnnLee"
    assert fix("nothing", pairs) == "nothing" and fix("", pairs) == "" and fix("x", [("", "y")]) == "x"


def test_vault_rules(spark):
    rows = spark.createDataFrame([(1, "s", "a@b.co"), (2, "s", "c@d.co")], "id int, session_id string, text string")
    masked = M.mask(rows, M.MaskOptions("k"))
    with pytest.raises(Exception, match="full"):
        M.build_vault(masked, "session_id", "id", cap=1).collect()
    vault = M.build_vault(masked, "session_id", "id")
    assert {(r.size, r.large) for r in M.vault_sizes(vault, 1).collect()} == {(2, True)}
    assert M.dispose(vault, ["s"]).count() == 0 and M.dispose(vault).count() == 0
    assert M.merge_vaults(vault, vault).count() == 2
    seen = spark.createDataFrame([("s", vault.first().token), ("s", "{{OPF:EMAIL:zzzzzzzzzzzzzzzz}}"), ("s", f"{{{{OPF:EMAIL:{T.epoch(T.token_key('k'))}aaaaaaaaaaaaa}}}}")], "session_id string, token string")
    assert sorted(r.status for r in M.token_status(seen, vault, "k").collect()) == ["expired", "foreign", "live"]


def test_idle_sessions_go(spark):
    from datetime import datetime

    used = spark.createDataFrame([(f"s{i}", datetime(2025, 1, 1, 12, i)) for i in range(5)], "session_id string, last_access timestamp")
    now = F.lit(datetime(2025, 1, 1, 12, 10))
    assert [r.session_id for r in M.retain(used, now, 60 * 9).collect()] == ["s4", "s3", "s2"]
    assert [r.session_id for r in M.retain(used, now, 3600, most=1).collect()] == ["s4"]


def test_neutralise(spark, vault):
    df = spark.createDataFrame([(1, "s", f"{MAIL} {{{{OPF:CARD:zzzzzzzzzzzzzzzz}}}} end")], "id int, session_id string, text string")
    assert R.neutralise(df, vault, SECRET, "id").first().neutral == f"{MAIL} [UNRESTORABLE:CARD/foreign] end"


def test_modes(spark):
    df = spark.createDataFrame([(1, "s", "mail alice@example.com card 4242 4242 4242 4242")], "id int, session_id string, text string")
    text = lambda **o: M.mask(df, M.MaskOptions("k", **o)).first().masked
    assert text(mode="hmac").startswith("mail [EMAIL:") and len(text(mode="hmac", hmac_chars=8).split("[EMAIL:")[1].split("]")[0]) == 8
    ruled = text(rules={"private_email": {"mode": "mask"}, "card": {"mode": "partial"}})
    assert ruled == "mail [EMAIL] card **** **** **** 4242"
    assert text(rules={"private_email": {"mode": "mask", "placeholder": "<x>"}}).startswith("mail <x> card {{OPF:CARD:")
    assert text(policy="passthrough") == df.first().text
    made = M.mask(df, M.MaskOptions("k", mode="synthetic"))
    assert "synthetic.user" in made.first().masked and "4242 4242 4242" in made.first().masked
    vault = M.build_vault(made, "session_id", "id")
    assert R.restore_synthetic(made.select("id", "session_id", F.col("masked").alias("text")), vault).first().restored == df.first().text
    assert M.synthetic_collisions(vault).count() == 0
    for bad in ({"mode": "x"}, {"policy": "x"}):
        with pytest.raises(ValueError):
            M.MaskOptions("k", **bad)


def test_synthetic_numbers_are_valid(spark):
    from umbraline.functions import checks

    rows = spark.range(1, 1200, 7).select(replacements.synthetic_rrn(F.col("id")).alias("r"), replacements.synthetic_biz(F.col("id")).alias("b"), replacements.synthetic_card(F.col("id")).alias("c"))
    assert rows.filter(~checks.rrn_ok(F.col("r")) | ~checks.biz_ok(F.col("b")) | ~checks.card_ok(F.col("c"))).count() == 0


def test_synthetic_keeps_the_particle(spark):
    fix = lambda text, keep=True: spark.createDataFrame([(text, ["김민준"], ["이영희"])], "t string, v array<string>, o array<string>").select(R.synthetic_restorer(keep)("t", "v", "o")).first()[0]
    assert fix("김민준이 왔다") == "이영희이 왔다" and fix("김민준이 왔다", False) == "이영희 왔다"
    assert fix("김민준호 왔다") == "김민준호 왔다"


def test_scoreboard(spark):
    df = spark.createDataFrame([(i, "s", f"mail user{i}@example.com and b{i}@example.com, card 4242 4242 4242 4242") for i in range(4)], "id int, session_id string, text string")
    masked = M.mask(df, M.MaskOptions("k"))
    vault = M.build_vault(masked, "session_id", "id")
    board = evals.scoreboard(masked.select("id", "session_id", "masked"), vault, "k")
    rows = {r.class_name: r for r in board.collect()}
    assert len(rows) == 16
    for r in rows.values():
        assert r.foreign_restorations == 0, r
        if r.kind != "probe":
            assert r.status == "ok", r
    assert evals.false_restoration_rate(board).first().false_restoration_rate == 0


def test_located_and_splits(spark):
    got = spark.range(1).select(evals.located(F.lit("a b a c"), F.array(F.lit("a"), F.lit("a"), F.lit("x"))).alias("l"), evals.splits(F.lit("abc")).alias("s")).first()
    assert got.l == [0, 4, -1] and [(s.first, s.second) for s in got.s] == [("a", "bc"), ("ab", "c")]


def test_note_and_hook(spark):
    note = lambda t: spark.range(1).select(M.with_note(F.lit(t).cast("string"))).first()[0]
    assert note(None) == M.SYSTEM_NOTE and note("a") == f"a\n\n{M.SYSTEM_NOTE}" and note(note("a")) == note("a")
    hook = lambda n, p, f=False: spark.range(1).select(M.hook_decision(F.lit(n), F.lit(p), F.lit(f))).first()[0]
    assert [hook(0, False), hook(1, False), hook(1, True), hook(0, True, True)] == ["allow_silent", "block", "allow_warn", "block"]
    assert M.bypassed(" ON ") and not M.bypassed("no") and not M.bypassed(None)


def test_secret_sources(tmp_path):
    path = str(tmp_path / "d" / "key")
    made, source = T.resolve_secret("K", path, {})
    assert source == "generated" and T.resolve_secret("K", path, {}) == (made, "file") and T.resolve_secret("K", path, {"K": "e"}) == ("e", "environment")
    assert T.resolve_secret("K", None, {})[1] == "ephemeral"
    assert oct((tmp_path / "d" / "key").stat().st_mode)[-3:] == "600"
