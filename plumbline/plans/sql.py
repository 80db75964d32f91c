"""SQL fragments that several queries share."""

from __future__ import annotations


def div(a: str, b: str, empty: str = "0.0::DOUBLE") -> str:
    return f"(CASE WHEN ({b}) = 0 THEN {empty} ELSE ({a})::DOUBLE / ({b}) END)"


RECALL, SPECIFICITY, PRECISION = div("tp", "tp + fn"), div("tn", "tn + fp"), div("tp", "tp + fp")
RATES = {
    "accuracy": div("tp + tn", "tp + fp + tn + fn"),
    "precision_": PRECISION,
    "recall": RECALL,
    "f1": div(f"2.0::DOUBLE * {PRECISION} * {RECALL}", f"{PRECISION} + {RECALL}"),
    "specificity": SPECIFICITY,
    "fpr": f"(1.0::DOUBLE - {SPECIFICITY})",
    "fnr": f"(1.0::DOUBLE - {RECALL})",
    "balanced_accuracy": f"(({RECALL} + {SPECIFICITY}) / 2.0::DOUBLE)",
    "youden_j": f"({RECALL} + {SPECIFICITY} - 1.0::DOUBLE)",
}


def rates(*names: str) -> str:
    return ", ".join(f"{RATES[n]} AS {n}" for n in (names or RATES))


def counts(decision: str, label: str = "binary_label") -> str:
    return (
        f"count(*) FILTER ({label} = 1 AND {decision}) AS tp, count(*) FILTER ({label} = 0 AND {decision}) AS fp, "
        f"count(*) FILTER ({label} = 0 AND NOT ({decision})) AS tn, count(*) FILTER ({label} = 1 AND NOT ({decision})) AS fn"
    )


def auc(rel: str, keys: str, label: str = "binary_label", score: str = "score") -> str:
    """SELECT keys, auc."""
    group = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {group}CASE WHEN sum({label}) = 0 OR sum({label}) = count(*) THEN NULL
      ELSE (sum(r) FILTER ({label} = 1) - sum({label})::DOUBLE * (sum({label}) + 1) / 2.0::DOUBLE) / (sum({label})::DOUBLE * (count(*) - sum({label}))) END AS auc
      FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({'PARTITION BY ' + group if keys else 'PARTITION BY '}{score}) - 1) / 2.0::DOUBLE AS r
            FROM {rel} WHERE {score} IS NOT NULL) {tail}"""


def metrics(rel: str, keys: str, threshold: float, label: str = "binary_label", score: str = "score") -> str:
    """CTEs cm (counts), au (auc) and m (keys, counts, auc, rates)."""
    on = f"JOIN au USING ({keys})" if keys else "CROSS JOIN au"
    tail = f"GROUP BY {keys}" if keys else ""
    group = f"{keys}, " if keys else ""
    return f"""cm AS (SELECT {group}{counts(f"{score} >= {threshold}", label)} FROM {rel} WHERE {score} IS NOT NULL {tail}),
    au AS ({auc(rel, keys, label, score)}),
    m AS (SELECT cm.*, au.auc, {rates()} FROM cm {on})"""
