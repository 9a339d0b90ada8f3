"""Forward passes against slow loops over the same formulas."""

import math

import numpy as np
import pytest

from scorelake.operators import nets
from scorelake.plans.weights import formula_weights


@pytest.fixture(scope="module")
def x():
    v = np.random.default_rng(1).normal(size=(3, 128))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def dense(w, name, v):
    out = []
    for row, bias in zip(w[f"{name}.weight"], w[f"{name}.bias"]):
        out.append(math.fsum(a * b for a, b in zip(row, v)) + bias)
    return out


def bn(w, name, v):
    return [(a - m) / math.sqrt(s + 1e-5) * g + b for a, m, s, g, b in zip(v, *(w[f"{name}.{p}"] for p in ("mean", "var", "gamma", "beta")))]


def relu(v):
    return [max(0.0, a) for a in v]


def ready(name):
    forward, prepare, _ = nets.SIGNAL_MODELS[name]
    w = formula_weights(name)
    return w, forward, prepare(dict(w)) if prepare else w


def test_classifier(x):
    w, forward, p = ready("ew_classifier")
    for v, got in zip(x, forward(p, x.copy())):
        for k in range(4):
            v = relu(bn(w, f"bn{k}", dense(w, f"fc{k}", v)))
        assert np.allclose(got, dense(w, "fc5", relu(dense(w, "fc4", v))))


def test_denoiser(x):
    w, forward, p = ready("signal_denoiser")
    for v, got in zip(x, forward(p, x.copy())):
        for name in ("enc0", "enc1", "enc2", "dec0", "dec1"):
            v = relu(dense(w, name, v))
        assert np.allclose(got, np.tanh(dense(w, "dec2", v)))


def test_prioritizer_is_attention_over_one_key(x):
    w, forward, p = ready("threat_prioritizer")
    for v, got in zip(x, forward(p, x.copy())):
        value = dense(w, "attn_v", dense(w, "proj", v))
        weight = math.exp(0.0) / math.exp(0.0)  # softmax over a single key
        v = dense(w, "attn_out", [weight * a for a in value])
        z = dense(w, "fc2", relu(dense(w, "fc1", relu(dense(w, "fc0", v)))))[0]
        assert got == pytest.approx(1 / (1 + math.exp(-z)))
        assert 0 <= got <= 1


def test_fingerprinter(x):
    w, forward, p = ready("rf_fingerprinter")
    got = forward(p, x[:1].copy())[0]
    chan = [list(x[0])]
    for k, (kernel, pad) in enumerate(nets._CONVS):
        weight, bias = w[f"conv{k}.weight"], w[f"conv{k}.bias"]
        padded = np.pad(np.array(chan), ((0, 0), (pad, pad)))
        out = []
        for o in range(weight.shape[0]):
            row = [max(0.0, float((weight[o] * padded[:, t : t + kernel]).sum() + bias[o])) for t in range(128)]
            scale = w[f"bn{k}.gamma"][o] / math.sqrt(w[f"bn{k}.var"][o] + 1e-5)
            out.append([(a - w[f"bn{k}.mean"][o]) * scale + w[f"bn{k}.beta"][o] for a in row])
        chan = out
    pooled = [sum(row[16 * s : 16 * s + 16]) / 16 for row in chan for s in range(8)]
    z = np.array(dense(w, "fc1", relu(dense(w, "fc0", pooled))))
    assert np.allclose(got, z / np.linalg.norm(z))


def test_anomaly(x):
    w, forward, p = ready("anomaly_detector")
    for v, got in zip(x, forward(p, x.copy())):
        h = dense(w, "mu", relu(dense(w, "enc1", relu(dense(w, "enc0", v)))))
        recon = dense(w, "dec2", relu(dense(w, "dec1", relu(dense(w, "dec0", h)))))
        assert got == pytest.approx(sum((a - b) ** 2 for a, b in zip(recon, v)))


def test_parameter_counts():
    def count(name):
        return sum(a.size for k, a in formula_weights(name).items() if not k.endswith((".mean", ".var")))

    counts = {n: count(n) for n in nets.SIGNAL_MODELS}
    assert counts["ew_classifier"] == 339_912 and counts["signal_denoiser"] == 140_192
    assert counts["rf_fingerprinter"] == 306_336
    # Query and key projections have no effect on one key and are not stored;
    # neither is the log-variance head, which evaluation does not use.
    assert counts["threat_prioritizer"] == 1_281_025 - 2 * (512 * 512 + 512)
    assert counts["anomaly_detector"] == 138_144 - (16 * 128 + 16)


def test_zero_embedding_does_not_divide_by_zero():
    w = formula_weights("rf_fingerprinter")
    w["fc1.weight"], w["fc1.bias"] = w["fc1.weight"] * 0, w["fc1.bias"] * 0
    out = nets.fingerprinter(nets.prepare_fingerprinter(w), np.zeros((1, 128)))
    assert np.array_equal(out, np.zeros((1, 32)))
