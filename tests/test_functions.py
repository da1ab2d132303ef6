import hashlib
import hmac
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import ids, net, scoring
from edgeloom.functions.keyed_hash import KeyedHash, equal_hex, link_proof, mac, mac_base64
from edgeloom.recipe import Privacy, Recipe, RetryPolicy, SettingsError

SALT = b"test-tenant-salt-12345"


def one(spark, hasher=None, **columns):
    df = spark.range(1)
    df = hasher.with_columns(df, columns) if hasher else df.withColumns(columns)
    return df.drop("id").first()


def test_mac_known_value_and_missing_input(spark):
    row = one(spark, KeyedHash(spark, SALT), a=mac(F.lit("customer_123")), b=mac(F.lit("")), c=mac(F.lit(None).cast("string")))
    assert tuple(row) == ("8cbc41d2b6e38c848f9cdc125c5c870a1473189ecfed4ea34251848dcbdc96b0", None, None)


@pytest.mark.parametrize("secret", [b"k", b"x" * 64, b"y" * 65, b"z" * 200, "sälz".encode()])
def test_mac_agrees_with_the_standard_library(spark, secret):
    text = "grüße|1"
    row = one(spark, KeyedHash(spark, secret), a=mac(F.lit(text)))
    assert row.a == hmac.new(secret, text.encode(), hashlib.sha256).hexdigest()


def test_empty_secret_is_refused_and_secrets_are_not_shown(spark):
    with pytest.raises(ValueError) as error:
        KeyedHash(spark, b"")
    assert "customer" not in str(error.value)
    assert "salt" not in repr(KeyedHash(spark, b"my-salt-value")) and "topsecret" not in repr(Privacy(b"topsecret"))


def test_link_proof(spark):
    row = one(
        spark, known=link_proof(F.lit("syn_cust_abc"), F.lit("syn_inv_123"), F.lit("recipe_v1")), ab=link_proof(F.lit("ab"), F.lit("c")),
        bc=link_proof(F.lit("a"), F.lit("bc")), abc=link_proof(F.lit("a"), F.lit("b"), F.lit("c")), cba=link_proof(F.lit("c"), F.lit("b"), F.lit("a")),
        none=link_proof(F.lit(None).cast("string"), F.lit("x")))
    assert row.known == "704cfc919ec44ce795a9804f7dd047ecad1df6266c12365ce125a446135b62a4"
    assert len(set(row)) == 6 and row.none == hashlib.sha256(b"\x1fx").hexdigest()
    with pytest.raises(ValueError):
        link_proof()


def test_equal_hex(spark):
    row = one(spark, a=equal_hex(F.lit("ABcd"), F.lit("abCD")), b=equal_hex(F.lit("ab"), F.lit("ac")), c=equal_hex(F.lit("xy"), F.lit("ab")), d=equal_hex(F.lit("abc"), F.lit("ab")))
    assert tuple(row) == (True, False, None, None)


def test_signed_message_known_value(spark):
    row = one(spark, KeyedHash(spark, b"test-secret-key"), a=mac_base64(F.lit('1234567890|abc123|{"test":"data"}')))
    assert row.a == "E6C+qCcMIM41g9WmsVmnVKxhldvdwtC6r4AXj3/OHPI="


def test_id_forms(spark):
    values = ["cus_a", "sub_a", "in_a", "price_a", "prod_a", "pi_a", "pm_a", "syn_cust_a", "random_string", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(ids.is_platform_id(F.col("v")), ids.is_synthetic(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(True, False)] * 7 + [(False, True)] + [(False, False)] * 3


def test_modes(spark):
    hasher = KeyedHash(spark, b"test_salt_for_synthetic_ids")
    row = one(spark, hasher, strict=ids.map_id(F.lit("prod_testABC"), "product"), kept=ids.map_id(F.lit("prod_testABC"), "product", "passthrough"), empty=ids.map_id(F.lit(""), "product", "passthrough"))
    assert tuple(row) == ("syn_prod_78d74faf20a5589d", "prod_testABC", None)
    for mode in ("invalid", "", "STRICT", "Passthrough"):
        with pytest.raises(SettingsError):
            ids.map_id(F.lit("x"), "product", mode)
        with pytest.raises(SettingsError):
            Privacy(b"s", mode)
    with pytest.raises(SettingsError):
        Privacy(b"")
    assert Privacy(b"", "passthrough").id_mode == "passthrough"


def test_within(spark):
    cases = [(1000, 1000, 60, True), (970, 1000, 60, True), (1030, 1000, 60, True), (940, 1000, 60, True), (1060, 1000, 60, True),
             (900, 1000, 60, False), (1100, 1000, 60, False), (1000, 1000, 0, False), (1000, 1000, -10, False)]
    rows = spark.createDataFrame(cases, "ts long, center long, w long, want boolean")
    assert all(r[0] == r[1] for r in rows.select(scoring.within(F.col("ts"), F.col("center"), F.col("w")), "want").collect())


def test_temporal_scores_print_as_c_does(spark):
    rows = spark.range(0, 3601).select("id", scoring.temporal_confidence(F.col("id"), 3600).alias("c")).select(
        "id", "c", scoring.two_decimals(F.lit(1.0) + F.lit(0.5) * F.col("c")).alias("text")).collect()
    for r in rows:
        c = min(0.6, max(0.0, 0.6 * (1.0 - r.id / 3600)))
        assert r.c == c and r.text == f"{1.0 + 0.5 * c:.2f}"
    assert one(spark, a=scoring.two_decimals(F.lit(1234.5))).a == "1234.50"


def test_notes_are_whole_unless_a_limit_is_given(spark):
    notes = [f"usage within {d}s of subscription creation" for d in range(10)]
    listed = F.array(*[F.lit(n) for n in notes])
    row = one(spark, a=scoring.combined_note(listed, F.lit(1.0)), b=scoring.combined_note(listed, F.lit(1.0), 200))
    assert row.a == "; ".join(notes) + " (score=1.00)" and row.b == row.a[:197] + "..."


def test_recipe():
    recipe = Recipe()
    assert (recipe.label, dict(recipe.weights), recipe.threshold, recipe.window_sec, recipe.sku_overlap_min) == (
        "default/v1", {"deterministic_id": 1.0, "temporal_proximity": 0.5, "sku_overlap": 0.8}, 0.8, 3600, 0.5)
    assert Recipe(threshold=0.0).threshold == 0.0 and Recipe(weights={"a": 1}).weight("b") == 0.0
    for bad in ({"threshold": 1.5}, {"threshold": -0.1}, {"window_sec": -1}, {"sku_overlap_min": 2}, {"weights": {"a": -1.0}}, {"name": ""}, {"version": ""}):
        with pytest.raises(SettingsError):
            Recipe(**bad)


def test_retry_waits():
    assert [RetryPolicy().wait(n) for n in range(6)] == [2, 4, 8, 16, 30, 30]


ADDRESSES = [
    ("192.168.1.100:12345", True), ("192.168.1.100", True), ("10.255.255.255:1", True), ("172.16.0.1:12345", False), ("10.0.0.256", False), ("010.0.0.1", False),
    ("[2001:db8::1]:443", True), ("2001:db8::1", True), ("2001:db8:0:0:0:0:0:1", True), ("2001:db9::1", False), ("[2001:db8::1]", False), ("::ffff:10.1.2.3", True),
    ("2001:db8::1::2", False), ("2001:db8:1", False), (":2001:db8::1", False), ("2001:db8::1:", False), ("2001:db8:1:2:3:4:5:6:7", False), ("::", False), ("", False), (None, False), ("garbage", False),
    ("2001:db8::12345", False), ("2001:DB8::A", True),
]


def test_address_ranges(spark):
    ranges = ["192.168.1.0/24", "10.0.0.0/8", "2001:db8::/32", "not-a-range", "300.1.1.1/8", "10.0.0.1"]
    df = net.address_columns(spark.createDataFrame(ADDRESSES, "a string, want boolean"), "a")
    wrong = [tuple(r) for r in df.select("a", "want", net.in_ranges(ranges).alias("got")).collect() if r.want != r.got]
    assert wrong == []
    assert df.where(net.in_ranges([])).count() == len(ADDRESSES)


def test_long_allow_lists_agree_with_brute_force(spark):
    """Ten thousand ranges, nested and touching ones among them, in one small plan."""
    rng = random.Random(9)
    nets = [ipaddress.ip_network((rng.getrandbits(32), rng.choice([12, 20, 24, 30, 32])), strict=False) for _ in range(6_000)]
    nets += [ipaddress.ip_network(((0x2001 << 112) | rng.getrandbits(90), rng.choice([48, 64, 96, 128])), strict=False) for _ in range(4_000)]
    near = [ipaddress.ip_address(int(n[side]) + off) for n in rng.sample(nets, 150) for side in (0, -1) for off in (-1, 0, 1) if 0 < int(n[side]) + off < 1 << n.max_prefixlen - 1]
    far = [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(200)]
    asked = [(str(a), any(a in n for n in nets if n.version == a.version)) for a in near + far]
    df = net.address_columns(spark.createDataFrame(asked, "a string, want boolean"), "a").select("a", "want", net.in_ranges([str(n) for n in nets]).alias("got"))
    assert [tuple(r) for r in df.collect() if r.want != r.got] == []
    assert {r.got for r in df.collect()} == {True, False}
