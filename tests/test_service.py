import pytest

from netfusion.service import accounts, ask, store
from netfusion.service.engine import Case


def test_accounts():
    a = accounts.Accounts(b"secret")
    a.register("sup", "longenough", "supervisor", "active")
    a.register("ana", "longenough", "analyst")
    with pytest.raises(PermissionError):
        a.login("ana", "longenough")
    a.set_state("ana", "active")
    token = a.login("ana", "longenough", now=1000)
    assert a.check(token, accounts.CAN_UPLOAD, now=1001)["role"] == "analyst"
    for bad in (lambda: a.check(token, accounts.CAN_VIEW_GRAPH, now=1001), lambda: a.check(token, now=1000 + accounts.TTL + 1), lambda: a.check(token[:-2] + "xx", now=1001), lambda: a.login("sup", "wrong")):
        with pytest.raises(PermissionError):
            bad()
    a.set_state("ana", "disabled")
    with pytest.raises(PermissionError):
        a.check(token, now=1001)
    assert [u["name"] for u in a.list()] == ["sup", "ana"]


def test_store_and_audit(spark, tmp_path):
    s = store.CaseStore(str(tmp_path / "cases"), kept=2)
    ids = [s.create(f"c{i}")["id"] for i in range(3)]
    assert [m["id"] for m in s.list()] == ids[:0:-1]
    s.save(ids[2], t=spark.range(3))
    assert s.load(spark, ids[2], "t").count() == 3 and s.update(ids[2], status="done")["status"] == "done"
    with pytest.raises(ValueError):
        s.path("../x")
    with pytest.raises(FileNotFoundError):
        s.load(spark, ids[2], "none")
    for i in range(3):
        store.audit(spark, str(tmp_path / "audit"), f"user{i}", "GET /leads", list(range(60)))
    rows = store.audit_trail(spark, str(tmp_path / "audit"), "LEADS", 2).collect()
    assert [r.user for r in rows] == ["user2", "user1"] and len(rows[0].result_ids) == 50


def test_questions():
    assert ask.parse("Who connects cell A and B?").template == 1
    q = ask.parse("Structuring around C12")
    assert q.template == 7 and q.params["ids"] == ["C12"]
    assert ask.parse("Transactions over 2 lakh").params["amount"] == 200_000
    assert ask.parse("Bursts on day 58").params["day"] == 58 and ask.parse("Calls from A1").template == 6


@pytest.fixture(scope="module")
def case(spark):
    people = [(f"{c}{i}", f"{n} {s}", "role", c, f"70000{k:05d}", f"AC0009{k:06d}", None, False, k) for k, (c, i, n, s) in enumerate((c, i, n, s) for c, s in zip("ABC", ("Kumar", "More", "Shaikh"), strict=True) for i, n in enumerate(("Ravi", "Sunil", "Anil", "Vijay"), 1))]
    p = spark.createDataFrame(people, "id string, name string, role string, cell string, phone string, account string, photo string, is_noise boolean, ordinal int")
    rows = []
    for d in range(1, 31):
        for c in "ABC":
            for k in range(8 if d == 20 else 1 + (d + ord(c)) % 3):
                a, b = f"{c}{1 + (k + d) % 4}", f"{c if k % 3 else 'B'}{1 + (k + d + 1) % 4}"
                rows.append((f"C{len(rows)}", a, a, "", b, b, "", f"2026-01-{d:02d} 10:00:00", d, "voice", 60, ("Eastgate", "Station Road")[k % 2]))
    cdrs = spark.createDataFrame(rows, "call_id string, caller_id string, caller_name string, caller_phone string, callee_id string, callee_name string, callee_phone string, timestamp string, day int, call_type string, duration_sec int, cell_tower_location string")
    t = [(f"T{i}", "A1", "", "", "C2", "", "", 9000, "", 10 + i % 6, "Cash") for i in range(12)] + [("T90", "C2", "", "", "C1", "", "", 300_000, "", 15, "Bank Transfer"), ("T91", "C2", "", "", "C1", "", "", 300_000, "", 20, "Bank Transfer")]
    txns = spark.createDataFrame(t, "txn_id string, sender_id string, sender_name string, sender_account string, receiver_id string, receiver_name string, receiver_account string, amount_inr long, timestamp string, day int, txn_type string")
    firs = spark.createDataFrame([(f"F{i}", "", i * 9, "", "Eastgate", "", "Ravi Kumar was seen meeting Sunil More. They left.") for i in range(1, 4)], "fir_id string, date string, day int, station string, location string, ipc_sections string, narrative string")
    surv = spark.createDataFrame([("S1", "", 5, "", "Station Road", "High", "Vijay Shaikh with Ravi Kumar near the docks.")], "report_id string, date string, day int, team string, location string, confidence string, activity_notes string")
    social = spark.createDataFrame([], "post_id string, handle string, person_id string, timestamp string, day int, location_tag string, post_text string, hashtags string")
    history = spark.createDataFrame([("R1", "A1", "Ravi Kumar", "", "", "murder", "G", "Dock Road, X")], "record_id string, person_id string, name string, alias string, dob string, prior_offences string, gang_affiliation string, known_address string")
    intel = spark.createDataFrame([], "report_id string, date string, day int, source_reliability string, narrative string, mentioned_entity_ids string")
    return Case(spark, {"people_directory": p, "cdrs": cdrs, "transactions": txns, "firs": firs, "surveillance_reports": surv, "social_posts": social, "criminal_history": history, "intelligence_reports": intel}, last_day=30)


def test_case_answers(case):
    assert {r.day for r in case.bursts().collect()} >= {20}
    assert [r.receiver for r in case.structuring().collect()] == ["C2"]
    shared = {r.entity: r.n_cases for r in case.cross_case().collect()}
    assert shared["A1"] == 4 and shared["B2"] == 3 and shared["LOC:Eastgate"] == 3
    leads = case.leads().collect()
    assert len(leads) >= 12 and all(0 <= r.lead_score <= 100 for r in leads) and leads[0].lead_score >= leads[-1].lead_score
    assert case.leads(3).count() == 3
    n, e = case.snapshot(20)
    assert e.where("day IS NOT NULL").count() > 0 and n.count() > 0
    calls = case.datasets["cdrs"].count()
    assert sum(r.call_count for r in case.towers().collect()) == sum(r.call_count for r in case.schematic().collect()) == calls
    assert case.hotspots().count() > 0 and case.trajectories(1, 5).count() > 0
    assert case.explain("B2", "A1").first().fir == 3
    assert case.recommendations().count() > 0 and case.strategies().count() > 0
    assert case.takedown(["C2"]).first().n_frozen == 14 and 0 <= case.what_if("C2").first().impact <= 100
    assert {r.strategy for r in case.strategies().collect()} == {"sync", "bridge", "decap", "mule"}
    order = case.operation_order(["A1", "C2"]).first()
    assert order.order_id == "OPORD-NCRB-OPERATION_THUNDERCLAP-2026" and order.armed == 2 and order.recovery == "Rs. 708,000"
    assert {r.id: r.risk_level for r in case.risks().collect()} == {"A1": "HIGH"}
    why = case.why("C2").first()
    assert why.anomaly_score == 1.0 and any(x.startswith("Lead score") for x in why.top_signals)
    known = case.sources("A1").collect()
    assert len(known) == 8 and {r.kind for r in known} >= {"OWNS_PHONE", "OWNED_BY"}
    sure, rest = case.entities()
    assert sure.where("confidence < 0.8").isEmpty() and {r.entity_type for r in rest.collect()} == {"Location", "Organization"}
    paper = case.certificate("Case", "now").first()
    assert paper.certificate_id == f"CERT-BSA63-{paper.master_root[:12].upper()}" and paper.n_blocks == 8 and paper.chain_valid
    assert case.search("ravi").count() == 3 and case.ask("Cell of A1?").count() == 1 and case.ask("Who connects cells").count() > 0
    assert case.stats().where("name = 'cdrs'").first().n == calls and case.communities().count() > 0


def test_case_ledger(case):
    from netfusion.operators import ledger

    leaves, blocks = case.ledger()
    assert blocks.count() == 8 and ledger.chain_valid(blocks).first().valid
    some = leaves.first().leaf
    assert ledger.verify(leaves, blocks, some).count() >= 1


def test_http(spark, case, tmp_path):
    import json
    import threading
    import urllib.request

    from netfusion.service import http

    book = accounts.Accounts(b"key")
    book.register("sup", "longenough", "supervisor", "active")
    book.register("ana", "longenough", "analyst", "active")
    api = http.Api({"": case, "c1": case}, book, str(tmp_path / "audit"))
    sup, ana = (api.answer("POST", "/login", {"name": n, "password": "longenough"})[1]["token"] for n in ("sup", "ana"))
    assert api.answer("GET", "/health") == (200, {"status": "ok", "cases": 2}) and api.answer("GET", "/stats")[0] == 403
    assert [r["receiver"] for r in api.answer("GET", "/structuring", token=ana)[1]] == ["C2"]
    assert api.answer("GET", "/graph?day=20", token=ana)[0] == 403 and len(api.answer("GET", "/investigations/c1/graph?day=20", token=sup)[1]["edges"]) > 5
    status, why = api.answer("GET", "/why/C2", token=ana)
    assert status == 200 and why["facts"][0]["id"] == "C2" and len(why["sources"]) == 8
    assert api.answer("POST", "/takedown/simulate", {"targets": ["C2"]}, ana)[1][0]["n_frozen"] == 14
    assert api.answer("GET", "/connections/explain?src=B2&dst=A1", token=ana)[1][0]["fir"] == 3
    assert [api.answer("GET", p, token=ana)[0] for p in ("/investigations/none/stats", "/nothing", "/people/search", "/geospatial/trajectories?from=x")] == [404, 404, 400, 400]
    assert api.answer("POST", "/register", {"name": "new", "password": "longenough"})[1]["state"] == "pending"
    assert api.answer("PATCH", "/admin/users/new", {"state": "active"}, ana)[0] == 403 and api.answer("PATCH", "/admin/users/new", {"state": "active"}, sup)[1]["state"] == "active"
    assert {r["query"] for r in api.answer("GET", "/admin/audit-trail?contains=why", token=sup)[1]} == {"GET /why/C2"}
    assert api.answer("DELETE", "/investigations/c1", token=sup)[0] == 200 and api.answer("GET", "/investigations", token=sup)[1] == []
    server = http.serve(api, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_address[1]}"
        assert urllib.request.urlopen(f"{base}/templates/firs.csv").read().decode().startswith("fir_id,date")
        asked = urllib.request.Request(f"{base}/people/search?q=ravi", headers={"Authorization": f"Bearer {ana}"})
        assert len(json.loads(urllib.request.urlopen(asked).read())) == 3
    finally:
        server.shutdown()
