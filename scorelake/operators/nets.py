"""Forward passes of the five signal models, in numpy, evaluation mode.

``prepare_*`` runs once per worker and rewrites stored weights for speed:
batch-norm statistics are folded into the layer before them, and affine layers
with nothing nonlinear between them are multiplied into one.
"""

from __future__ import annotations

import numpy as np

BN_EPS = 1e-5  # fixed value: batch-norm epsilon

Weights = dict[str, np.ndarray]


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0, out=x)


def _dense(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """``x @ W.T + b`` with ``W`` stored as (out, in)."""
    y = x @ w[f"{name}.weight"].T
    y += w[f"{name}.bias"]
    return y


def _bn_scale(w: Weights, name: str) -> tuple[np.ndarray, np.ndarray]:
    scale = w[f"{name}.gamma"] / np.sqrt(w[f"{name}.var"] + BN_EPS)
    return scale, w[f"{name}.beta"] - w[f"{name}.mean"] * scale


def _merge(w: Weights, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One affine map equal to the named layers applied in turn."""
    weight, bias = w[f"{names[0]}.weight"], w[f"{names[0]}.bias"]
    for name in names[1:]:
        bias = w[f"{name}.weight"] @ bias + w[f"{name}.bias"]
        weight = w[f"{name}.weight"] @ weight
    return weight, bias


def _dense_stack(w: Weights, names: list[str], x: np.ndarray) -> np.ndarray:
    """Dense layers with ReLU between them, none after the last."""
    for name in names[:-1]:
        x = _relu(_dense(w, name, x))
    return _dense(w, names[-1], x)


# -- classifier: dense blocks with batch norm, then a two-layer head -> logits


def prepare_classifier(w: Weights) -> Weights:
    out = {k: v for k, v in w.items() if not k.startswith("bn")}
    for k in range(4):
        scale, shift = _bn_scale(w, f"bn{k}")
        out[f"fc{k}.weight"] = w[f"fc{k}.weight"] * scale[:, None]
        out[f"fc{k}.bias"] = w[f"fc{k}.bias"] * scale + shift
    return out


def classifier(w: Weights, x: np.ndarray) -> np.ndarray:
    return _dense_stack(w, [f"fc{k}" for k in range(6)], x)


# -- denoiser: autoencoder, ReLU also on the code, tanh at the end -> vector


def denoiser(w: Weights, x: np.ndarray) -> np.ndarray:
    return np.tanh(_dense_stack(w, ["enc0", "enc1", "enc2", "dec0", "dec1", "dec2"], x))


# -- prioritizer: attention over one key is a plain affine map -> score in [0, 1]


def prepare_prioritizer(w: Weights) -> Weights:
    out = {k: v for k, v in w.items() if k.startswith(("fc1", "fc2"))}
    out["fc0.weight"], out["fc0.bias"] = _merge(w, ["proj", "attn_v", "attn_out", "fc0"])
    return out


def prioritizer(w: Weights, x: np.ndarray) -> np.ndarray:
    z = _dense_stack(w, ["fc0", "fc1", "fc2"], x)[:, 0]
    return 1.0 / (1.0 + np.exp(-z))


# -- fingerprinter: three convolutions, pooled, two dense layers -> unit vector

_CONVS = ((7, 3), (5, 2), (3, 1))  # kernel and padding of each convolution
_POOL = 8
_CONV_ROWS = 64  # rows unrolled at a time, so one step stays small in memory


def prepare_fingerprinter(w: Weights) -> Weights:
    out = {k: v for k, v in w.items() if not k.startswith("bn")}
    for k in range(3):
        out[f"bn{k}.scale"], out[f"bn{k}.shift"] = _bn_scale(w, f"bn{k}")
        # (out, in, kernel) -> (kernel * in, out), the layout of an unrolled window
        out[f"conv{k}.matrix"] = np.ascontiguousarray(w[f"conv{k}.weight"].transpose(2, 1, 0).reshape(-1, w[f"conv{k}.weight"].shape[0]))
    return out


def _conv_features(w: Weights, x: np.ndarray) -> np.ndarray:
    n, length = x.shape
    h = x[:, :, None]  # (rows, position, channel)
    for k, (kernel, pad) in enumerate(_CONVS):
        padded = np.pad(h, ((0, 0), (pad, pad), (0, 0)))
        windows = np.concatenate([padded[:, t : t + length, :] for t in range(kernel)], axis=2)
        h = windows.reshape(n * length, -1) @ w[f"conv{k}.matrix"]
        h += w[f"conv{k}.bias"]
        h = _relu(h)
        h *= w[f"bn{k}.scale"]
        h += w[f"bn{k}.shift"]
        h = h.reshape(n, length, -1)
    pooled = h.reshape(n, _POOL, length // _POOL, -1).mean(axis=2)
    return pooled.transpose(0, 2, 1).reshape(n, -1)  # channel-major, as flattened features


def fingerprinter(w: Weights, x: np.ndarray) -> np.ndarray:
    parts = [_conv_features(w, x[i : i + _CONV_ROWS]) for i in range(0, len(x), _CONV_ROWS)]
    z = _dense_stack(w, ["fc0", "fc1"], np.concatenate(parts))
    length = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return z / np.maximum(length, 1e-12)


# -- anomaly detector: autoencoder through the mean code -> summed squared error


def anomaly(w: Weights, x: np.ndarray) -> np.ndarray:
    h = _relu(_dense(w, "enc0", x))
    h = _relu(_dense(w, "enc1", h))
    z = _dense(w, "mu", h)
    diff = _dense_stack(w, ["dec0", "dec1", "dec2"], z) - x
    return np.einsum("ij,ij->i", diff, diff)


# -- a linear stub for modalities whose networks are not shipped


def linear(w: Weights, x: np.ndarray) -> np.ndarray:
    return _dense(w, "fc", x)


def centroid(w: Weights, x: np.ndarray) -> np.ndarray:
    """Similarity to each class centroid; a row of ``centers`` per class."""
    return x @ w["centers"].T


SIGNAL_MODELS = {
    "ew_classifier": (classifier, prepare_classifier, "logits"),
    "signal_denoiser": (denoiser, None, "vector"),
    "threat_prioritizer": (prioritizer, prepare_prioritizer, "score"),
    "rf_fingerprinter": (fingerprinter, prepare_fingerprinter, "vector"),
    "anomaly_detector": (anomaly, None, "score"),
}

# Layer name -> stored shape, for an input of 128 values.
LAYERS = {
    "ew_classifier": {
        "fc0": (256, 128), "bn0": (256,), "fc1": (512, 256), "bn1": (512,), "fc2": (256, 512), "bn2": (256,),
        "fc3": (128, 256), "bn3": (128,), "fc4": (64, 128), "fc5": (8, 64),
    },
    "signal_denoiser": {
        "enc0": (256, 128), "enc1": (128, 256), "enc2": (32, 128), "dec0": (128, 32), "dec1": (256, 128), "dec2": (128, 256),
    },
    "threat_prioritizer": {
        "proj": (512, 128), "attn_v": (512, 512), "attn_out": (512, 512), "fc0": (256, 512), "fc1": (128, 256), "fc2": (1, 128),
    },
    "rf_fingerprinter": {
        "conv0": (32, 1, 7), "bn0": (32,), "conv1": (64, 32, 5), "bn1": (64,), "conv2": (128, 64, 3), "bn2": (128,),
        "fc0": (256, 1024), "fc1": (32, 256),
    },
    "anomaly_detector": {
        "enc0": (256, 128), "enc1": (128, 256), "mu": (16, 128), "dec0": (128, 16), "dec1": (256, 128), "dec2": (128, 256),
    },
}
