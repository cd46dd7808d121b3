import pytest

from netfusion.service.engine import Case
from netfusion.sources.files import read_table, table_encoding
from netfusion.sources.upload import upload


@pytest.fixture
def files(tmp_path):
    (tmp_path / "bank.csv").write_text('Trans ID;Payer ID;Beneficiary ID;Txn Amount;Date\n7;A1;B2;"₹2,50,000";05/01/2026\n8;;B3;100;2026-01-06\n9;A4;;5k;\n', encoding="utf-8")
    (tmp_path / "more.csv").write_text("utr,who paid,who got,rs\n10,A9,B9,1.5L\n", encoding="utf-8")
    (tmp_path / "odd.csv").write_text("colour,shape\nred,round\n", encoding="utf-8")
    (tmp_path / "people.tsv").write_bytes("Person ID\tFull Name\tGang Cell\tPhone Number\tBank Account\nA1\tZoé Köhler\tA\t7000000001\tAC1\n".encode("latin-1"))
    (tmp_path / "calls.json").write_text('[{"caller_phone": "7000000001", "callee_phone": "7000000009", "day": "3", "call_duration": "61"}]', encoding="utf-8")
    return tmp_path


def test_files_with_foreign_headers_become_a_case(spark, files):
    names = ["bank.csv", "odd.csv", "people.tsv", "calls.json"]
    case = Case.from_files(spark, [str(files / n) for n in names])
    got = case.datasets["transactions"].orderBy("txn_id").collect()
    assert [(r.txn_id, r.sender_id, r.receiver_id, r.amount_inr, r.timestamp[:10]) for r in got] == [("7", "A1", "B2", 250_000, "2026-01-05")]
    assert sorted((r.source_file, r.row_no, r.reason) for r in case.quarantine.collect()) == [
        ("bank.csv", 3, "Missing/invalid required field(s): sender_id / sender_account"),
        ("bank.csv", 4, "Missing/invalid required field(s): receiver_id / receiver_account"),
        ("odd.csv", 0, "Unknown dataset"),
    ]
    assert [r.name for r in case.datasets["people_directory"].collect()] == ["Zoé Köhler"]
    call = case.datasets["cdrs"].first()
    assert (call.caller_phone, call.callee_phone, call.day, call.duration_sec) == ("7000000001", "7000000009", 3, 61)
    assert case.datasets["firs"].columns[0] == "fir_id" and case.datasets["firs"].isEmpty()
    assert case.txns.count() == 1 and {r.id for r in case.people.collect()} >= {"A1"}
    assert case.options["files"]["bank.csv"][0] == "transactions"


def test_a_given_mapping_is_used(spark, files):
    mapping = {"txn_id": "utr", "sender_id": "who paid", "receiver_id": "who got", "amount_inr": "rs", "sender_account": None, "receiver_account": None, "sender_name": None, "receiver_name": None, "timestamp": None, "day": None, "txn_type": None}
    got = upload(spark, [str(files / "bank.csv"), str(files / "more.csv")], {"more.csv": mapping})
    assert {(r.txn_id, r.amount_inr) for r in got.datasets["transactions"].collect()} == {("7", 250_000), ("10", 150_000)}


def test_encoding_of_tables_is_tried(spark, tmp_path):
    (tmp_path / "utf.csv").write_text("name,town\nZoé,Köln\n", encoding="utf-8-sig")
    (tmp_path / "latin.csv").write_bytes("name,town\nZoé,Köln\n".encode("latin-1"))
    assert table_encoding(spark, str(tmp_path / "utf.csv")) == "UTF-8" and table_encoding(spark, str(tmp_path / "latin.csv")) == "ISO-8859-1"
    for name in ("utf.csv", "latin.csv"):
        assert [tuple(r) for r in read_table(spark, str(tmp_path / name)).select("name", "town").collect()] == [("Zoé", "Köln")]


def test_no_files(spark):
    got = upload(spark, [])
    assert got.quarantine.isEmpty() and all(df.isEmpty() for df in got.datasets.values()) and not got.files
