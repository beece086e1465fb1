"""The comparator's decision table, the residue rule and the grammar, each in one job."""

from pyspark.sql import functions as F

from attestor.functions import stats
from attestor.operators.compare import compare, source_grounded

ROWS = [
    ("10 mg/kg", "20 mg/kg PO", False, "DIFFER"), ("10 mg/kg", "10 mg/kg PO", False, "INCOMPARABLE"), ("5-10 mg/kg", "7 mg/kg", False, "MATCH"), ("5-10 mg/kg", "20 mg/kg", False, "DIFFER"),
    ("7 mg/kg", "5-10 mg/kg", False, "INCOMPARABLE"), ("$100M+", "$150M", False, "MATCH"), ("$100M+", "$50M", False, "DIFFER"), ("12-16 weeks", "40-50 weeks after v0.5", False, "DIFFER"),
    ("12-16 weeks", "12-16 weeks after v0.5", False, "INCOMPARABLE"), ("$500K-$2M", "between $500K and $2M", False, "MATCH"), ("5-10 mg/kg", "7-15 mg/kg", False, "INCOMPARABLE"),
    ("5 g", "5000 mg", False, "INCOMPARABLE"), ("90 minutes", "45 minutes", False, "DIFFER"), ("90 minutes", "1 hr 30 min", False, "INCOMPARABLE"), ("2E2", "20E1", False, "INCOMPARABLE"),
    ("1.2e17 atoms", "120000000000000000 atoms", True, "MATCH"), ("4.6-5.2", "9.0", True, "DIFFER"), ("3:1", "20:1", True, "DIFFER"), ("2 1/2 inch", "2.5 inch", True, "MATCH"),
    ("Café Ristretto", "Café Ristretto", False, "MATCH"), ("Board Certified", "board-certified", False, "MATCH"), ("red", "blue", False, "DIFFER"), ("red", "unknown", False, "INCOMPARABLE"),
    ("$5k cloud credit", "$5k", False, "INCOMPARABLE"), ("150 million dollars", "$150M", False, "MATCH"), ("1e-400 m", "1e-500 m", True, "INCOMPARABLE"), ("red", None, False, "INCOMPARABLE"),
    ("x" * 600, "x", False, "INCOMPARABLE"), ("$199", "199 mg", False, "INCOMPARABLE"), ("", "", False, "MATCH"),
]


def test_decision_table(spark):
    df = spark.createDataFrame(ROWS, "declared string, claimed string, numeric boolean, expected string")
    assert compare(df).where("outcome <> expected").collect() == []


def test_residue(spark):
    rows = [
        ("10 mg/kg", "10 mg/kg PO", "Give 10 mg/kg PO daily. Stop after.", True),
        ("35 dollars", "35 dollars per month", "The fee is 35 dollars per month, not free.", False),
        ("35 dollars", "35 dollars per month", "The fee is 35 dollars per month.", True),
        ("95.0 percent", "95.0 percent of label claim", "within 95.0 percent of label claim", True),
        ("35 dollars", "35 dollars per 2 months", "It is 35 dollars per 2 months.", False),
        ("35 dollars", None, "It is 35 dollars.", False),
    ]
    df = spark.createDataFrame(rows, "d string, c string, s string, expected boolean")
    assert df.where(source_grounded(F.col("d"), F.col("c"), F.col("s"), F.col("c")) != F.col("expected")).collect() == []


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (0, 366), (33, 209)], "k long, n long")
    got = {(r.k, r.n): (round(r.lo, 4), round(r.hi, 4)) for r in stats.with_wilson(df, "k", "n").collect()}
    assert got[0, 0] == (0.0, 1.0) and got[0, 366] == (0.0, 0.0104) and got[33, 209] == (0.1147, 0.2134)
