"""Ready-made pipelines, as descriptions to run or to start from.

``${IN}`` and ``${OUT}`` are the input and output paths.
"""

from __future__ import annotations


def flow(name: str, *steps: tuple[str, dict]) -> dict:
    """A linear pipeline description; step ids are s0, s1, ..."""
    nodes = [
        {"id": f"s{i}", "type": "pipelineNode", "data": {"typeId": kind, "params": params}}
        for i, (kind, params) in enumerate(steps)
    ]
    edges = [{"id": f"e{i}", "source": f"s{i}", "target": f"s{i + 1}"} for i in range(len(steps) - 1)]
    return {"id": name, "name": name, "nodes": nodes, "edges": edges}


IN = ("import_dataset", {"path": "${IN}"})

# The names, steps and parameters of the published templates.
FLOWS = {
    f["name"]: f
    for f in (
        flow(
            "alpaca",
            IN,
            ("lowercase", {"column": "instruction"}),
            ("remove_empty", {"columns": "instruction,output"}),
            ("dedup_exact", {"method": "exact"}),
            ("write_jsonl", {"path": "${OUT}"}),
        ),
        flow(
            "fineweb",
            IN,
            ("strip_tags", {"column": "text"}),
            ("unicode_normalize", {"column": "text", "form": "NFC"}),
            ("dedup_exact", {"method": "simhash", "column": "text", "order_by": "${ORDER}"}),
            ("write_parquet", {"path": "${OUT}"}),
        ),
        flow(
            "tinystories",
            IN,
            ("unicode_normalize", {"column": "story", "form": "NFC"}),
            ("regex_replace", {"column": "story", "pattern": r"\s+", "replacement": " "}),
            ("write_jsonl", {"path": "${OUT}"}),
        ),
        flow(
            "finetune",
            ("load_csv", {"path": "${IN}"}),
            ("lowercase", {"column": "text"}),
            ("unicode_normalize", {"column": "text", "form": "NFC"}),
            ("remove_empty", {"columns": "text"}),
            ("write_jsonl", {"path": "${OUT}"}),
        ),
        flow(
            "rag",
            ("load_json", {"path": "${IN}"}),
            ("strip_html", {"column": "text"}),
            ("unicode_normalize", {"column": "text", "form": "NFC"}),
            ("chunk_text", {"column": "text", "chunk_size": 500, "chunk_overlap": 50, "id_column": "${ORDER}"}),
            ("write_jsonl", {"path": "${OUT}"}),
        ),
        flow(
            "sharegpt",
            ("load_json", {"path": "${IN}"}),
            ("rename_columns", {"mapping": {"role": "from", "text": "value"}}),
            ("regex_replace", {"column": "value", "pattern": r"\s+", "replacement": " "}),
            ("write_jsonl", {"path": "${OUT}"}),
        ),
        flow(
            "ocr",
            ("load_csv", {"path": "${IN}"}),
            ("regex_replace", {"column": "text", "pattern": r"\s*([.,?!])\s*", "replacement": r"\1 "}),
            ("length_filter", {"column": "text", "min_len": 200}),
            ("write_csv", {"path": "${OUT}"}),
        ),
        flow(
            "common_crawl",
            ("load_jsonl", {"path": "${IN}"}),
            ("strip_html", {"column": "html"}),
            ("language_filter", {"column": "html", "target_lang": "en"}),
            ("dedup_exact", {"method": "hash", "column": "html", "order_by": "${ORDER}"}),
            ("write_parquet", {"path": "${OUT}"}),
        ),
        flow(
            "tinystories_words",
            ("load_jsonl", {"path": "${IN}"}),
            ("strip_html", {"column": "text"}),
            ("length_filter", {"column": "text", "min_len": 50, "max_len": 500, "unit": "words"}),
            ("write_csv", {"path": "${OUT}"}),
        ),
    )
}
