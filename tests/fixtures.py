"""Hand-built inputs with exactly known results."""

from edgeloom import schemas
from edgeloom.operators.matchers import LinkInputs

T = 1704067200
A, B = "syn_cust_123456789abc", "syn_cust_abc987654321"
LOOSE1, LOOSE2 = "syn_user_a1b2c3d4e5f6", "syn_user_f6e5d4c3b2a1"
P1, P2 = "syn_price_p11111111", "syn_price_p22222222"
S1, S2 = "syn_sub_sub1111111111", "syn_sub_sub2222222222"
I1, I2 = "syn_inv_inv1111111111", "syn_inv_inv2222222222"

MATCHER_SALT = b"test-tenant-salt-12345"

NOTE_SUB = "usage within {}s of subscription creation"
NOTE_INV = "usage within {}s of invoice creation"

# (from, to, kind, confidence, at, notes, proof)
MATCHER_EDGES = [
    (A, I1, "user->invoice", 1.0, T + 300,
     "exact customer ID match; usage within 0s of invoice creation; usage within 300s of invoice creation (score=1.30)",
     "eb20d2cf3c66f7691b27d6f34fddf3c99a39caa8453b4836c187231bf66c1280"),
    (A, P1, "user->price", 1.0, T + 300, "exact SKU-price match (score=1.72)",
     "5054bd50c59d83028e687c7a1c7b5c7c4b16cec0fbc49b84b5149ef50b58700c"),
    (A, S1, "user->subscription", 1.0, T + 300,
     "SKU matched subscription price; exact customer ID match; usage within 0s of subscription creation; "
     "usage within 300s of subscription creation (score=1.94)",
     "02f1b678d526b36214182d340b9f56d32b4083839cd8bddcf0faaf77421445b5"),
    (B, I2, "user->invoice", 1.0, T + 7200, "exact customer ID match (score=1.00)",
     "8fb19c35f0ac22af453e1ebed5eba940f9f1d22bee569d848eccea8375ed04bb"),
    (B, P2, "user->price", 1.0, T + 7200, "exact SKU-price match (score=1.72)",
     "9390ddad49d3ba8b0fa3e18f06297a00b0364b5ee649b2cd318ce2d96c1b6a2d"),
    (B, S2, "user->subscription", 1.0, T + 7200, "SKU matched subscription price; exact customer ID match (score=1.64)",
     "891f2ccb7a26c2c2204673ab007c97301220ec7ebc9cb0dad828fb2b38b85f19"),
    (LOOSE2, S1, "user->subscription", 0.94, T, "SKU matched subscription price; usage within 0s of subscription creation (score=0.94)",
     "9607c787db1fffbbbb876cff21e5567e74642aca8e4246a04211d3d38d383926"),
]


def inputs(spark, usages, subs, invs):
    return LinkInputs(
        spark.createDataFrame(usages, schemas.USAGE),
        spark.createDataFrame(subs, schemas.SUBSCRIPTION_LITE),
        spark.createDataFrame(invs, schemas.INVOICE_LITE),
    )


def matcher_inputs(spark):
    return inputs(
        spark,
        [(A, "export_csv", P1, T), (A, "api_call", P1, T + 300), (B, "export_csv", P2, T + 7200),
         (LOOSE1, "unknown_feature", "syn_price_unknown", T + 10000), (LOOSE2, "api_call", P1, T)],
        [(S1, A, [P1], ["syn_prod_prod111111"], T, "active"), (S2, B, [P2], ["syn_prod_prod222222"], T, "active")],
        [(I1, A, S1, 5000, "usd", "paid", T, True), (I2, B, S2, 10000, "usd", "paid", T, True)],
    )


PIPELINE_SALT = b"test-pipeline-salt-12345"
C1, C2 = "syn_cust_testcust1111", "syn_cust_testcust2222"

# (to, at, end of the notes, proof)
PIPELINE_EDGES = [
    ("syn_inv_testinv111111", T, "(score=1.30)", "d546186726965c7c5d53120b81b2900157d4f1265c70d45e7cb5a2f6576b744e"),
    ("syn_price_testprice1", T, "(score=1.72)", "ca892ffa3fe8cba9f3f9c0fb80d1a6a2fa8cf410a20353f11a40390bb85b4ee8"),
    ("syn_sub_testsub111111", T, "(score=1.94)", "051967e16eb60f9986ec964112c02a158594afbb0ae24d6d5604b73f05f950ea"),
    ("syn_inv_testinv222222", T + 300, "(score=1.27)", "67f72440ff28c307dadcb7ce25e333093dc8f72f21db1f52a5264922a6b4e0e1"),
    ("syn_price_testprice2", T + 300, "(score=1.72)", "99f5c8db8cf35b3ec37a2b533adc89051e60f043d9f79b11cc2450322ff7e597"),
    ("syn_sub_testsub222222", T + 300, "(score=1.92)", "4b31c1efa0f69ec0937a8c47c69d0c5f5c2beef65ee2f9a969a8fe93a4fe69f9"),
]


def pipeline_inputs(spark):
    return inputs(
        spark,
        [(C1, "export_csv", "syn_price_testprice1", T), (C2, "api_call", "syn_price_testprice2", T + 300)],
        [("syn_sub_testsub111111", C1, ["syn_price_testprice1"], ["syn_prod_testprod111"], T, "active"),
         ("syn_sub_testsub222222", C2, ["syn_price_testprice2"], ["syn_prod_testprod222"], T, "active")],
        [("syn_inv_testinv111111", C1, "syn_sub_testsub111111", 5000, "usd", "paid", T, True),
         ("syn_inv_testinv222222", C2, "syn_sub_testsub222222", 10000, "usd", "paid", T, True)],
    )
