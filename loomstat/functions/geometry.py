"""4 by 4 and 3 by 3 matrices of image headers: inverses, quaternions, orientation. For header rows, not for voxels."""

from __future__ import annotations

import numpy as np

Matrix = list[list[float]]


def inverse4(m: Matrix) -> Matrix:
    """Inverse of an affine map; zeros if there is none."""
    a = np.array(m, float)
    if a.shape == (3, 4):
        a = np.vstack([a, [0, 0, 0, 1]])
    det = np.linalg.det(a[:3, :3])
    if det == 0:
        return np.zeros((4, 4)).tolist()
    out = np.eye(4)
    out[:3, :3] = np.linalg.inv(a[:3, :3])
    out[:3, 3] = -out[:3, :3] @ a[:3, 3]
    return out.tolist()


def compose(*m: Matrix) -> Matrix:
    """The map that applies the last matrix first."""
    out = np.eye(4)
    for a in m:
        out = out @ np.array(a, float)
    return out.tolist()


def polar(m: Matrix) -> Matrix:
    """The orthogonal matrix next to a 3 by 3 one."""
    u, _, vt = np.linalg.svd(np.array(m, float))
    return (u @ vt).tolist()


def from_quaternion(b: float, c: float, d: float, offset: tuple[float, float, float], spacing: tuple[float, float, float], qfac: float) -> Matrix:
    """Affine map of a unit quaternion, given without its first part, with spacing; qfac < 0 turns the third axis."""
    a2 = 1 - (b * b + c * c + d * d)
    if a2 < 1e-7:
        s = 1 / np.sqrt(b * b + c * c + d * d)
        b, c, d, a = b * s, c * s, d * s, 0.0
    else:
        a = np.sqrt(a2)
    x, y, z = (v if v > 0 else 1.0 for v in spacing)
    z = -z if qfac < 0 else z
    r = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b],
    ])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r * [x, y, z], offset
    return out.tolist()


def to_quaternion(m: Matrix) -> dict[str, float]:
    """Quaternion, offset, spacing and qfac of an affine map."""
    a = np.array(m, float)
    spacing = np.linalg.norm(a[:3, :3], axis=0)
    cols = np.where(spacing > 0, a[:3, :3] / np.where(spacing > 0, spacing, 1), np.eye(3))
    r = np.array(polar(cols.tolist()))
    qfac = 1.0
    if np.linalg.det(r) < 0:
        r[:, 2], qfac = -r[:, 2], -1.0
    # The quaternion is the eigenvector of the largest eigenvalue of a symmetric 4 by 4 matrix of r.
    k = np.array([
        [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
        [r[0, 2] - r[2, 0], r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]],
        [r[1, 0] - r[0, 1], r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1]],
    ])
    q = np.linalg.eigh(k)[1][:, -1]
    q = -q if q[0] < 0 else q
    return {"b": float(q[1]), "c": float(q[2]), "d": float(q[3]), "x": float(a[0, 3]), "y": float(a[1, 3]), "z": float(a[2, 3]), "dx": float(spacing[0]), "dy": float(spacing[1]), "dz": float(spacing[2]), "qfac": qfac}


def orientation(m: Matrix) -> str:
    """Three letters that say where each voxel axis points most: L or R, P or A, I or S as i, j, k grow."""
    from itertools import permutations

    a = np.array(m, float)[:3, :3]
    n = np.linalg.norm(a, axis=0)
    a = a / np.where(n > 0, n, 1)
    best = max(permutations(range(3)), key=lambda p: sum(abs(a[p[c], c]) for c in range(3)))
    return "".join("RAS"[best[c]] if a[best[c], c] >= 0 else "LPI"[best[c]] for c in range(3))
