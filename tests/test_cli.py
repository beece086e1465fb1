"""Every command once, on files of a few rows."""

import json

import pytest

from attestor import cli
from attestor.sources import files

SPEC = {
    "domain": "clinic", "corpus": "Give 10 mg/kg PO daily.", "entities": {"paracetamol": ["APAP"]}, "relations": {"dose": {"kind": "quantity", "question": "what is the dose of {entity}?"}},
    "facts": [{"s": "paracetamol", "r": "dose", "o": "10 mg/kg", "source": "Give 10 mg/kg PO daily."}],
}
TRIALS = [
    ("1", "FAITHFUL", "For APAP give 10 mg/kg.", "10 mg/kg"), ("2", "CORRUPTED", "For APAP give 20 mg/kg.", "20 mg/kg"), ("3", "FAITHFUL", "For APAP give some.", "unknown"), ("4", "SPONTANEOUS", "APAP: 30 mg/kg", "10 mg/kg"),
]


@pytest.fixture(scope="module")
def here(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    kb = [{"s": f"c{i}", "r": "locatedin", "o": f"r{i % 3}"} for i in range(30)] + [{"s": f"r{i}", "r": "isa", "o": "region"} for i in range(3)]
    (top / "triples.jsonl").write_text("\n".join(map(json.dumps, kb)) + '\n\n{"s": "torn\n')
    (top / "held.jsonl").write_text(json.dumps({"s": "lost", "r": "isa", "o": "x"}) + "\n")
    (top / "spec.json").write_text(json.dumps(SPEC))
    (top / "texts.jsonl").write_text("\n".join(json.dumps({"trial": t, "condition": c, "entity": "paracetamol", "relation": "dose", "text": x}) for t, c, x, _ in TRIALS))
    (top / "answers.jsonl").write_text("\n".join(json.dumps({"trial": t, "entity": "paracetamol", "relation": "dose", "answer": a}) for t, _, _, a in TRIALS))
    files.ingest(spark, f"{top}/triples.jsonl", f"{top}/kb")
    return str(top)


def run(spark, capsys, *arguments):
    cli.main(list(arguments), spark)
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_build_kb(spark, here, capsys):
    assert run(spark, capsys, "build-kb", "--source", f"{here}/triples.jsonl", "--out", f"{here}/kb2")[0] == {"facts": 33, "relations": 2, "entities": 34, "histogram": {"locatedin": 30, "isa": 3}}


def test_generate_and_validate(spark, here, capsys):
    counts = run(spark, capsys, "generate", "--source", f"{here}/triples.jsonl", "--out", f"{here}/sft", "--limit", "20", "--holdout", f"{here}/held.jsonl")
    assert {r["generator"]: r["n"] for r in counts} == {"qa": 20, "chains": 5, "idk": 6, "corrupt": 4}
    assert run(spark, capsys, "validate", f"{here}/sft") == [{"valid": 35, "total": 35}]
    with pytest.raises(SystemExit):
        cli.main(["validate", f"{here}/triples.jsonl"], spark)


def test_splits_bench_and_results(spark, here, capsys):
    cli.main(["splits"], spark)
    assert "unknowable" in capsys.readouterr().out
    made = run(spark, capsys, "splits", "--splits", "unknowable", "knowable_heldout", "--kb", f"{here}/kb", "--holdout", f"{here}/held.jsonl", "--out", f"{here}/splits", "--n", "10")
    assert {r["split"]: r["n"] for r in made} == {"unknowable": 1, "knowable_heldout": 10}
    summary = run(spark, capsys, "bench", "--split", f"{here}/splits/knowable_heldout", "--kb", f"{here}/kb", "--out", f"{here}/results")
    assert summary[0]["n"] == 10 and summary[0]["correct"] == 0 and summary[0]["claims_checked"] == 0
    cli.main(["results", "--results", f"{here}/results"], spark)
    assert "| echo | 0.00% (0.00% to " in capsys.readouterr().out


def test_domain_commands(spark, here, capsys):
    recorded = ("--domain", f"{here}/spec.json", "--texts", f"{here}/texts.jsonl", "--answers", f"{here}/answers.jsonl")
    told = run(spark, capsys, "domain-bench", *recorded)
    assert told[0]["leaks"] == 0 and told[0]["n_corrupted"] == 2 and told[0]["over_blocked"] == 1 and told[0]["faithful_verified"] == 1 and told[0]["wrong_block"] == 1
    assert told[1:] == [{"hold": "no_claim_linked", "n": 1}]
    assert run(spark, capsys, "pilot", *recorded)[0]["breaches"] == 0
    assert run(spark, capsys, "coverage", *recorded)[0]["adjudicated"] == 2
    assert run(spark, capsys, "soak", *recorded) == []


def test_policy_and_holdout(spark, here, capsys):
    assert run(spark, capsys, "policy", "--claims", f"{here}/triples.jsonl", "--kb", f"{here}/kb")[0]["verified"] == 33
    cli.main(["holdout", "--source", f"{here}/triples.jsonl", "--out", f"{here}/halves", "--size", "7"], spark)
    assert files.read_triples(spark, f"{here}/halves/holdout").count() == 7 and files.read_triples(spark, f"{here}/halves/train").count() == 26
