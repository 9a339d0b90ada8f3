"""Reproducible network weights from a formula, in numpy and in SQL.

No trained networks are shipped. These weights let every forward pass be
checked against an independent SQL evaluation of the same layers.
"""

from __future__ import annotations

import numpy as np

from ..operators.nets import LAYERS


def _weight(i, j, layer: int, fan_in: int):
    return np.sin(i * j * 0.37 + i * 1.1 + j * 0.7 + layer) * (1.5 / np.sqrt(fan_in))


def formula_layer(shape: tuple[int, ...], layer: int) -> dict[str, np.ndarray]:
    """Weight and bias of an affine layer, or the four vectors of a batch norm."""
    i = np.arange(shape[0], dtype="float64")
    if len(shape) == 1:
        return {
            "gamma": 1 + 0.2 * np.sin(i + layer),
            "beta": 0.1 * np.sin(2 * i + layer),
            "mean": 0.1 * np.sin(3 * i + layer),
            "var": 1 + 0.5 * np.sin(0.5 * i + layer),
        }
    fan_in = int(np.prod(shape[1:]))
    j = np.arange(fan_in, dtype="float64")
    return {"weight": _weight(i[:, None], j[None, :], layer, fan_in).reshape(shape), "bias": 0.1 * np.sin(i * 0.9 + layer)}


def formula_weights(model: str) -> dict[str, np.ndarray]:
    out = {}
    for layer, (name, shape) in enumerate(LAYERS[model].items()):
        out.update({f"{name}.{part}": data for part, data in formula_layer(shape, layer).items()})
    return out


def layer_sql(model: str, name: str, order: str = "j") -> str:
    """Rows (i, w, b) of an affine layer; ``order`` lists each unit's weights."""
    layer, shape = list(LAYERS[model]).index(name), LAYERS[model][name]
    fan_in = int(np.prod(shape[1:]))
    return (
        f"SELECT i, list(sin(i * j * 0.37::DOUBLE + i * 1.1::DOUBLE + j * 0.7::DOUBLE + {layer}) * (1.5::DOUBLE / sqrt({fan_in}::DOUBLE)) ORDER BY {order}) AS w, "
        f"0.1::DOUBLE * sin(i * 0.9::DOUBLE + {layer}) AS b FROM range({shape[0]}) r(i), range({fan_in}) c(j) GROUP BY i"
    )


def norm_sql(model: str, name: str, x: str) -> str:
    """Batch norm of ``x`` at unit ``i``."""
    k = list(LAYERS[model]).index(name)
    return (
        f"(({x}) - 0.1::DOUBLE * sin(3 * i + {k}::DOUBLE)) / sqrt(1 + 0.5::DOUBLE * sin(0.5::DOUBLE * i + {k}) + 0.00001::DOUBLE) "
        f"* (1 + 0.2::DOUBLE * sin(i + {k}::DOUBLE)) + 0.1::DOUBLE * sin(2 * i + {k}::DOUBLE)"
    )


def dense_sql(model: str, steps: list[tuple[str, str]], source: str, prefix: str) -> tuple[str, str]:
    """CTEs applying affine layers in turn; each step names a layer and an SQL
    template of its activation over ``{y}``. Returns the CTEs and the last name."""
    ctes, previous = [], source
    for n, (name, activation) in enumerate(steps):
        w, h = f"{prefix}w{n}", f"{prefix}h{n}"
        value = activation.format(y="y")
        ctes.append(f"{w} AS MATERIALIZED ({layer_sql(model, name)})")
        ctes.append(
            f"{h} AS MATERIALIZED (SELECT signal_id, list({value} ORDER BY i) AS v FROM "
            f"(SELECT signal_id, i, list_dot_product(v, w) + b AS y FROM {previous}, {w}) GROUP BY signal_id)"
        )
        previous = h
    return ", ".join(ctes), previous
