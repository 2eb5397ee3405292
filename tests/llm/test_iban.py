from touchline.llm import private_data

ACCOUNTS = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874",
            "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"]


def test_account_before_capitals(spark):
    forms = [f(a) for a in ACCOUNTS for f in (str, lambda a: a.replace(" ", ""))]
    notes = [t for a in forms for t in (a, f"pay {a} BIC GEBABEBB", f"{a} 1234 5678", f"({a}) EUR 20")]
    notes += ["BE68 5390 0754 7035 BIC GEBABEBB"]
    df = spark.createDataFrame(list(enumerate(notes)), "event_id int, note string")
    got = {r.event_id: [r.note[s.start:s.end] for s in r.spans if s.kind == "iban"] for r in private_data.find_private(df).collect()}
    assert [got[i] for i in range(len(notes))] == [[a] for a in forms for _ in range(4)] + [[]]
