"""Small seeded NumPy helpers for bounded groups; no Spark in here."""

from __future__ import annotations

import numpy as np


def principal_axes(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, axes (columns; the largest loading positive) and deviations of the scores (ddof 1)."""
    mean = x.mean(axis=0)
    _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    axes = vt[: min(k, len(s))].T
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return mean, axes * np.where(flip == 0, 1, flip), s[: axes.shape[1]] / np.sqrt(max(len(x) - 1, 1))


def scores(x: np.ndarray, k: int, whiten: bool = False) -> np.ndarray:
    mean, axes, deviation = principal_axes(x, k)
    out = (x - mean) @ axes
    return out / np.where(deviation > 1e-12, deviation, 1) if whiten else out


def zscores(x: np.ndarray) -> np.ndarray:
    std = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(std > 0, std, 1)


def fisher_axis(mean1: np.ndarray, mean2: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The discriminant direction of two groups: pinv(within scatter) (m2 - m1), of unit length."""
    axis = np.linalg.pinv(within, rcond=1e-9, hermitian=True) @ (mean2 - mean1)
    length = np.linalg.norm(axis)
    return axis / length if length > 0 else axis


def discriminant(x: np.ndarray, y: np.ndarray, k: int = 2) -> np.ndarray:
    """Projection of x on the (at most classes - 1) discriminant axes of the labels y."""
    groups = [x[y == c] for c in np.unique(y)]
    if len(groups) < 2:
        return scores(x, k)
    within = sum((g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in groups)
    between = np.stack([np.sqrt(len(g)) * (g.mean(axis=0) - x.mean(axis=0)) for g in groups])
    value, vector = np.linalg.eigh(within + 1e-9 * np.trace(within) * np.eye(len(within)) / len(within) + 1e-12 * np.eye(len(within)))
    root = vector / np.sqrt(value)
    _, _, vt = np.linalg.svd(between @ root, full_matrices=False)
    axes = root @ vt[: min(k, len(groups) - 1)].T
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return (x - x.mean(axis=0)) @ (axes * np.where(flip == 0, 1, flip))


def group_axes(n: np.ndarray, means: np.ndarray, within: np.ndarray, k: int) -> np.ndarray:
    """The k discriminant axes (columns) of three or more groups, else the k principal axes of all their
    rows, from counts, means and the summed scatter within; the largest loading is positive."""
    between = np.sqrt(n)[:, None] * (means - n @ means / n.sum())
    size = len(within)
    if len(n) > 2:
        value, vector = np.linalg.eigh(within + (1e-9 * np.trace(within) / size + 1e-12) * np.eye(size))
        root = vector / np.sqrt(value)
        axes = root @ np.linalg.svd(between @ root, full_matrices=False)[2][: min(k, len(n) - 1)].T
    else:
        axes = np.linalg.eigh(within + between.T @ between)[1][:, ::-1][:, :k]
    flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return axes * np.where(flip == 0, 1, flip)


def ks_statistic(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in (a, b))


def fitted_gap(a: np.ndarray, b: np.ndarray) -> float:
    """The Kolmogorov-Smirnov statistic of two samples on their discriminant axis."""
    axis = fisher_axis(a.mean(axis=0), b.mean(axis=0), _within(a, b))
    return ks_statistic(a @ axis, b @ axis)


#: Rows a dimension from which an axis that is fitted on a sample tells nothing false about it.
ROWS_A_DIMENSION = 9


def unseen_gap(a: np.ndarray, b: np.ndarray, folds: int = 5) -> float:
    """The same for rows on axes that the others fit: by how much more of a than of b lies on a's side.
    The scatter is drawn towards a sphere, the more the fewer rows there are. 1 for samples with rows
    enough (the harmonic mean of both) for fitted_gap."""
    d = a.shape[1]
    if min(len(a), len(b)) < 3 or 2 * len(a) * len(b) / (len(a) + len(b)) >= ROWS_A_DIMENSION * d:
        return 1.0
    out = [np.empty(len(a)), np.empty(len(b))]
    for f in range(folds):
        left = [np.arange(len(x)) % folds != f for x in (a, b)]
        one, other = a[left[0]], b[left[1]]
        free = max(len(one) + len(other) - 2, 1)
        scatter, share = _within(one, other) / free, d / (d + free)
        scatter = (1 - share) * scatter + (share * np.trace(scatter) / d + 1e-12) * np.eye(d)
        axis = np.linalg.solve(scatter, other.mean(axis=0) - one.mean(axis=0))
        size = np.sqrt(axis @ scatter @ axis)
        axis = axis / size if size > 0 else axis
        middle = (one.mean(axis=0) + other.mean(axis=0)) / 2
        for x, kept, to in zip((a, b), left, out):
            to[~kept] = (x[~kept] - middle) @ axis
    at = np.concatenate(out)
    return float((np.searchsorted(np.sort(out[0]), at, "right") / len(a) - np.searchsorted(np.sort(out[1]), at, "right") / len(b)).max())


def chance_gap(n: int, m: int, limit: float, chance: float = 1e-8) -> float:
    """The limit, or what two samples of one distribution exceed by chance only, if that is more; under 1,
    since samples without any overlap are two."""
    return min(max(limit, gap_by_chance(n, m, chance)), 1 - 1e-9)


def gap_by_chance(n: int, m: int, chance: float) -> float:
    return float(np.sqrt(np.log(1 / chance) * (n + m) / (2 * n * m)))


#: Least share of a sample that a group must have in it, and how much likelihood (logarithm) must be lost
#: without it (half of it, if there is one group alone that has moved).
SHARE, TOLD = 0.2, 3.0


def sphered(groups: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups' means and the rows of x in a measure in which the groups' scatter is a sphere of unit
    size. The scatter is drawn towards a sphere as far as its distance from one is chance (Ledoit and Wolf)."""
    d, free = x.shape[1], max(sum(len(g) - 1 for g in groups), 1)
    rows = np.concatenate([g - g.mean(axis=0) for g in groups])
    within = rows.T @ rows / free
    level, size = np.trace(within) / d, (within**2).sum()
    apart, chance = size - d * level**2, ((rows**2).sum(axis=1) ** 2).sum() / free**2 - size / free
    share = float(np.clip(chance / apart, 0, 1)) if apart > 0 else 1.0
    low = np.linalg.cholesky((1 - share) * within + (share * level + 1e-9 * level + 1e-12) * np.eye(d))
    return np.linalg.solve(low, np.stack([g.mean(axis=0) for g in groups]).T).T, np.linalg.solve(low, x.T).T


def shares(means: np.ndarray, x: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """The rows' parts in unit spheres about the means, in shares that suit the rows best, and the
    likelihood (logarithm, but for a constant)."""
    log, weight, likelihood = -0.5 * ((x[:, None] - means) ** 2).sum(axis=2), np.full(len(means), 1 / len(means)), -np.inf
    for _ in range(rounds):
        before = likelihood
        resp, likelihood = responsibilities(log + np.log(weight))
        if likelihood - before < 1e-2:
            break
        weight = np.maximum(resp.mean(axis=0), 1e-12)
    return resp, likelihood


#: So many rows a row are taken to be spread evenly over the groups beforehand.
EVEN = 0.1


def likeliest(groups: list[np.ndarray], x: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The rows' shares in the groups, and the groups' means (sphered). The means are those of the groups'
    rows and of the rows of x together, in so far as these are theirs."""
    first, x = sphered(groups, x)
    sizes, means, before = np.array([len(g) for g in groups])[:, None], first, -np.inf
    weight, even = np.full(len(groups), 1 / len(groups)), EVEN * len(x)
    for _ in range(rounds):
        resp, likelihood = responsibilities(-0.5 * ((x[:, None] - means) ** 2).sum(axis=2) + np.log(weight))
        if likelihood - before < 1e-2:
            break
        before, mass = likelihood, resp.sum(axis=0)
        weight = (mass + even) / (len(x) + even * len(groups))
        means = (sizes * first + resp.T @ x) / (sizes + mass[:, None])
    return resp, first


def purest(resp: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Parts 0, 1, ... of rows with these shares in groups, so that the least pure part is as pure as it can
    be: whom most rows belong to would else take in many of a small group, or a small part hold many others'."""
    log, bias, best = np.log(np.maximum(resp, 1e-300)), np.zeros(resp.shape[1]), (-1.0, resp.argmax(axis=1))
    for r in range(rounds):
        part = (log + bias).argmax(axis=1)
        mass = np.bincount(part, minlength=len(bias))
        pure = np.array([resp[part == j, j].mean() if mass[j] else 1.0 for j in range(len(bias))])
        if mass.min() and pure.min() > best[0]:
            best = float(pure.min()), part
        bias = bias + 4 * 0.96**r * (pure - pure.mean())
    return np.unique(best[1], return_inverse=True)[1]


#: Groups whose means lie closer (in their scatter) have no dip between them but by chance.
APART = 3.0


def assigned(groups: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Parts 0, 1, ... of the rows of x, which the groups have in common: the dips along the axis that tells
    the likeliest groups apart set them where the groups lie apart, else the shares alone."""
    resp, means = likeliest(groups, x)
    part = purest(resp)
    between = np.sqrt(((means[:, None] - means) ** 2).sum(axis=2))[~np.eye(len(means), dtype=bool)]
    return guided_split(x, part, 0, len(groups)) if between.min() >= APART else part


def told_apart(groups: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As sphered, only where the groups' means differ: no other direction tells them apart."""
    means, x = sphered(groups, x)
    middle = means.mean(axis=0)
    axes = np.linalg.svd(means - middle, full_matrices=False)[2][: len(groups) - 1].T
    return (means - middle) @ axes, (x - middle) @ axes


def holds_several(groups: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Which of the groups the sample x holds, where it holds several: likelihood is lost without any of
    these, or if there is one alone that has moved to the sample's mean, and the rows of each lie about
    its mean. What a mean fitted on the sample gains by chance, and means fitted on other rows lose, is
    taken off."""
    held = np.zeros(len(groups), bool)
    if len(groups) < 2:
        return held
    means, x = told_apart(groups, x)
    d = x.shape[1]
    which = np.flatnonzero(shares(means, x)[0].mean(axis=0) >= SHARE / 2)
    if len(which) < 2:
        return held
    sizes = np.array([len(g) for g in groups])
    alone = -0.5 * ((x - x.mean(axis=0)) ** 2).sum() - d / 2
    resp, likelihood = shares(means[which], x)
    while len(which) > 1 and likelihood + 0.5 * d * (resp.sum(axis=0) / sizes[which]).sum() - alone >= TOLD / 2:
        if len(which) > 2:
            without = [shares(means[np.delete(which, j)], x) for j in range(len(which))]
            least = int(np.argmax([fit[1] for fit in without]))
            if likelihood - without[least][1] < TOLD:
                which, (resp, likelihood) = np.delete(which, least), without[least]
                continue
        near = [resp[:, i] @ ((x - means[j]) ** 2).sum(axis=1) <= 2 * d * resp[:, i].sum() for i, j in enumerate(which)]
        which = which[(resp.mean(axis=0) >= SHARE) & near]
        held[which] = len(which) > 1
        break
    return held


def linked(groups: list[np.ndarray], x: np.ndarray, gaps: list[float], limit: float, chance: float) -> np.ndarray:
    """Which of the groups the sample x continues, by their gaps (fitted_gap): those under the limit, but for
    one that has next to no share in x where another of these explains it. Over the limit: where nothing is
    under it, one whose gap on unseen rows is no more than chance; else one that is over it by no more than
    chance gives, or by unseen rows isn't, if x holds several."""
    near, maybe = np.array(gaps) < limit, np.zeros(len(groups), bool)
    for i, a in enumerate(groups):
        if not near[i]:
            maybe[i] = unseen_gap(a, x) < chance_gap(len(a), len(x), limit)
    if not near.any():
        near, maybe = maybe, ~maybe & False
    maybe |= ~near & (np.array(gaps) <= [limit + gap_by_chance(len(a), len(x), chance) for a in groups])
    if near.sum() > 1:
        share = shares(*told_apart(groups, x))[0].mean(axis=0)
        near &= (share >= SHARE) | ~near[share.argmax()]
    return near | (maybe & holds_several(groups, x)) if maybe.any() else near


def neighbours(x: np.ndarray, k: int, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of the k nearest other points, in chunks of rows; ties by row."""
    square, near, rows = (x**2).sum(axis=1), [], []
    for i in range(0, len(x), chunk):
        d = np.maximum(square[i : i + chunk, None] + square[None] - 2 * x[i : i + chunk] @ x.T, 0)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near.append(np.sqrt(np.take_along_axis(d, order, 1)))
        rows.append(order)
    return np.concatenate(near), np.concatenate(rows)


def local_outlier_factor(x: np.ndarray, k: int = 20) -> np.ndarray:
    """About 1 inside a cluster, more the more isolated a point is."""
    if len(x) < 3:
        return np.ones(len(x))
    near, rows = neighbours(x, min(k, len(x) - 1))
    reach = np.maximum(near, near[:, -1][rows])
    density = 1 / (reach.mean(axis=1) + 1e-10)
    return density[rows].mean(axis=1) / density


def knn_vote(x: np.ndarray, labels: np.ndarray, k: int = 20) -> np.ndarray:
    """Majority label of the k nearest points, the point itself among them; ties to the smallest."""
    k = 2 if len(x) <= k else k
    if len(x) < 2:
        return labels.copy()
    _, rows = neighbours(x, min(k - 1, len(x) - 1))
    votes = np.concatenate([labels[:, None], labels[rows]], axis=1)
    values = np.unique(labels)
    return values[(votes[:, :, None] == values).sum(axis=1).argmax(axis=1)]


def kmeans_centres_1d(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Ascending centres of weighted k-means of numbers, started at weighted quantiles."""
    k = min(k, len(np.unique(x)))
    order = np.argsort(x, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum()
    centres = np.unique(x[order][np.searchsorted(share, (np.arange(k) + 0.5) / k)])
    for _ in range(rounds):
        label = np.abs(x[:, None] - centres).argmin(axis=1)
        new = np.array([np.average(x[label == j], weights=weight[label == j]) if (label == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return np.sort(centres)


def weighted_kmeans_1d(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Labels of weighted k-means of numbers; they ascend with the centres."""
    return np.abs(x[:, None] - kmeans_centres_1d(x, weight, k, rounds)).argmin(axis=1)


def log_densities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Of each row and Gaussian component, weight included."""
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, x.T - mean[:, :, None])
    size = np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1) + 0.5 * x.shape[1] * np.log(2 * np.pi)
    return np.log(weight) - size - 0.5 * (z**2).sum(axis=1).T


def second_moments(resp: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each component: its shares times x times xT, summed."""
    return (resp.T[:, None] * x.T) @ x


def responsibilities(log: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the components in each row, and the likelihood of all rows (logarithm)."""
    top = log.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(log - top).sum(axis=1, keepdims=True))
    return np.exp(log - total), float(total.sum())


Components = tuple[np.ndarray, np.ndarray, np.ndarray]


def components_of_sums(mass: np.ndarray, first: np.ndarray, second: np.ndarray, n: float, ridge: float) -> Components:
    """Weights, means and covariances from the components' summed shares, and shares times x and times x xT."""
    mass = mass + 1e-9
    mean = first / mass[:, None]
    cov = second / mass[:, None, None] - mean[:, :, None] * mean[:, None, :] + ridge * np.eye(first.shape[1])
    return mass / n, mean, cov


def ridge_of(variances: np.ndarray) -> float:
    return 1e-3 * float(variances.mean()) + 1e-9


def fit_mixture(x: np.ndarray, k: int, seed: int, rounds: int = 60) -> tuple[Components, np.ndarray, float]:
    """A full-covariance Gaussian mixture by seeded expectation-maximisation: its components, the rows'
    shares in them, and the likelihood (logarithm)."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(n)]]
    for _ in range(1, k):  # spread-out starts
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(n, p=far / far.sum()) if far.sum() > 0 else rng.integers(n)])
    middle, ridge = x.mean(axis=0), ridge_of(x.var(axis=0))
    x = x - middle
    resp = np.eye(k)[((x[:, None] - (np.array(centres) - middle)) ** 2).sum(axis=2).argmin(axis=1)]
    likelihood = -np.inf
    for _ in range(rounds):
        weight, mean, cov = components_of_sums(resp.sum(axis=0), resp.T @ x, second_moments(resp, x), n, ridge)
        before = likelihood
        resp, likelihood = responsibilities(log_densities(x, weight, mean, cov))
        if likelihood - before < 1e-4 * abs(likelihood):
            break
    return (weight, mean + middle, cov), resp, likelihood


def bic(k: int, d: int, n: float, likelihood: float) -> float:
    return (k * (1 + d + d * (d + 1) / 2) - 1) * np.log(n) - 2 * likelihood


def mixture(x: np.ndarray, k: int, seed: int, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Labels of a mixture, and its BIC."""
    _, resp, likelihood = fit_mixture(x, k, seed, rounds)
    return resp.argmax(axis=1), bic(k, x.shape[1], len(x), likelihood)


def most_parts(n: int, d: int, most: int) -> int:
    """So many parts of a mixture at most can be told from so many rows."""
    return max(1, min(most, n // (d + 2)))


def best_mixture(x: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Labels 0, 1, ... of the mixture with the least BIC among 1 to `most` parts."""
    fits = [mixture(x, k, seed) for k in range(1, most_parts(len(x), x.shape[1], most) + 1)]
    return np.unique(min(fits, key=lambda f: f[1])[0], return_inverse=True)[1]


def monotone(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit, by pooling adjacent violators."""
    level, weight, size = [], [], []
    for v, u in zip(y.tolist(), w.tolist()):  # numbers of Python: far faster one by one
        level.append(v), weight.append(u), size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            u = weight[-2] + weight[-1]
            v = (level[-2] * weight[-2] + level[-1] * weight[-1]) / u
            n = size.pop() + size.pop()
            del level[-2:], weight[-2:]
            level.append(v), weight.append(u), size.append(n)
    return np.repeat(level, size)


def dip_of_counts(counts: np.ndarray, edges: np.ndarray, threshold: float = 1.0) -> float | None:
    """Where a histogram falls apart: the deepest dip, if counts with one peak fit badly (by the
    largest gap between the cumulated counts); else None. Histograms add up, so the sample itself may
    lie anywhere."""
    bins, n = len(counts), counts.sum()
    y, w = counts.astype("float64"), np.ones(bins)
    smooth = np.convolve(y, np.ones(3) / 3, "same")
    fits = []
    for peak in np.argsort(-smooth)[: max(3, bins // 6)]:
        fit = np.concatenate([monotone(y[: peak + 1], w[: peak + 1]), monotone(y[peak + 1 :][::-1], w[peak + 1 :])[::-1]])
        fits.append((float(((y - fit) ** 2).sum()), int(peak), fit))
    fit = min(fits, key=lambda f: f[:2])[2]
    if np.abs(np.cumsum(y) - np.cumsum(fit)).max() / np.sqrt(n) < threshold:
        return None
    lack = np.cumsum(y - fit)
    worst = int(np.abs(lack).argmax())
    depth = np.convolve(fit - y, np.ones(3) / 3, "same")
    around = np.arange(max(1, worst - bins // 3), min(bins - 1, worst + bins // 3 + 1))
    at = around[depth[around].argmax()]
    return float((edges[at] + edges[at + 1]) / 2)


def split_1d(x: np.ndarray, threshold: float = 1.0, bins: int = 0) -> float | None:
    """Where a one-dimensional sample falls apart, by the dip of its histogram; None if it doesn't."""
    n = len(x)
    if n < 8 or np.ptp(x) == 0:
        return None
    return dip_of_counts(*np.histogram(x, bins or int(np.clip(np.sqrt(n) * 1.5, 6, 60))), threshold)


def parts_1d(x: np.ndarray, start: int = 24, threshold: float = 1.0) -> np.ndarray:
    """Parts 0, 1, ... of a one-dimensional sample in ascending order. It starts as many intervals of
    equal counts; the nearest two neighbours are tested together, and become one where their union
    has one peak, else the border between them moves to the dip. It ends when every pair of
    neighbours shows a dip."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    line = x[order]
    borders = np.unique(np.linspace(0, n, min(start, max(1, n // 12)) + 1).astype(int)).tolist()
    settled: set[tuple[int, int, int]] = set()
    for _ in range(8 * start):
        centres = [line[a:b].mean() for a, b in zip(borders, borders[1:])]
        todo = [(centres[i + 1] - centres[i], i) for i in range(len(borders) - 2) if tuple(borders[i : i + 3]) not in settled]
        if not todo:
            break
        i = min(todo)[1]
        a, _, b = borders[i : i + 3]
        cut = split_1d(line[a:b], threshold)
        if cut is None:
            del borders[i + 1]
        else:
            borders[i + 1] = int(np.clip(a + np.searchsorted(line[a:b], cut, "right"), a + 1, b - 1))
            settled.add(tuple(borders[i : i + 3]))
    part = np.empty(n, "int64")
    part[order] = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    return part


def guided_split(x: np.ndarray, labels: np.ndarray | None, seed: int, parts: int | None = None) -> np.ndarray:
    """Parts 0, 1, ...: labels (given, or of a two-part mixture) set an axis, and the dips along it the
    parts; given labels stay if another number of parts than asked for comes out."""
    if labels is None:
        labels = mixture(scores(x, 3), 2, seed)[0] if len(x) > 8 else np.zeros(len(x), "int64")
    values = np.unique(labels)
    if len(values) < 2:
        return np.zeros(len(x), "int64")
    found = parts_1d(discriminant(x, labels, 1)[:, 0])
    if parts is not None and found.max() + 1 != parts:
        return np.searchsorted(values, labels)
    return found


def inlier_by_zscore(x: np.ndarray, limit: float = 2.0) -> np.ndarray:
    """Rows whose largest standardised principal score (of two at most) is under the limit."""
    if len(x) <= 4:
        return np.ones(len(x), bool)
    s = scores(x, min(2, x.shape[1]))
    return np.abs(zscores(s)).max(axis=1) < limit


def exponential_rate(centres: np.ndarray, density: np.ndarray, rounds: int = 200) -> float | None:
    """The l of the least-squares fit of l * exp(-l x), by damped Gauss-Newton from 1 / mean."""
    if len(centres) == 0 or not np.isfinite(density).all() or density.sum() <= 0:
        return None
    rate = float(density.sum() / max((density * centres).sum(), 1e-12))
    cost = lambda r: float(((density - r * np.exp(-r * centres)) ** 2).sum())
    for _ in range(rounds):
        e = np.exp(-rate * centres)
        slope = e * (1 - rate * centres)
        step = float((slope * (density - rate * e)).sum() / max((slope**2).sum(), 1e-300))
        while abs(step) > 1e-14 * rate and (rate + step <= 0 or cost(rate + step) > cost(rate)):
            step /= 2
        rate += step
        if abs(step) <= 1e-10 * rate:
            break
    return rate
