"""Eigenvalues and eigenvectors of a positive semidefinite matrix of whole numbers, from its exact characteristic polynomial.

The polynomial is found modulo many primes, by reduction to Hessenberg form, and put together by Chinese remaindering; a bound on its coefficients
says how many primes are enough. Repeated roots are told apart exactly, by greatest common divisors with the derivative. All roots are real, so the sign
changes of the polynomial moved to a point count the roots beyond that point exactly: bisection on these counts isolates them, and signs of exact values
narrow them down. A root's vectors come from the null space of the matrix less the root, by inverse iteration in whole numbers of a small unit.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from math import comb, isqrt
from random import Random

import numpy as np


def is_prime(n: int) -> bool:
    """For odd numbers below 2 ** 32, where these bases leave no liar."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes():
    """Primes below 2 ** 31, from above: products of two residues fit into 64 bits."""
    return (n for n in range(2**31 - 1, 2**30, -2) if is_prime(n))


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient is larger: the roots are not negative and their sum is the trace."""
    n = len(matrix)
    mean = sum(matrix[i][i] for i in range(n)) // max(n, 1) + 1
    return max(comb(n, k) * mean**k for k in range(n + 1))


def enough_primes(matrix: list[list[int]]) -> list[int]:
    """Primes whose product tells all coefficients apart, with their signs."""
    out, product, need = [], 1, 2 * coefficient_bound(matrix) + 1
    for p in primes():
        if product >= need:
            return out
        out.append(p)
        product *= p
    raise ValueError("matrix too large for primes of 31 bits")


def polynomial_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo ``p``, constant first."""
    a = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(len(matrix), len(matrix))
    n = len(a)
    for k in range(n - 2):
        filled = np.flatnonzero(a[k + 1:, k])
        if not len(filled):
            continue
        pivot = k + 1 + int(filled[0])
        if pivot != k + 1:
            a[[pivot, k + 1]] = a[[k + 1, pivot]]
            a[:, [pivot, k + 1]] = a[:, [k + 1, pivot]]
        factor = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - factor[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * factor % p).sum(1)) % p
    # polynomials of the leading blocks, one from all before it
    leading = np.zeros((n + 1, n + 1), np.int64)
    leading[0, 0] = 1
    for k in range(n):
        weights, path = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * path % p
            path = path * int(a[i, i - 1]) % p if i else path
        leading[k + 1, 1:] = leading[k, :-1]
        leading[k + 1] = (leading[k + 1] - (weights[:, None] * leading[:k + 1] % p).sum(0)) % p
    return leading[n]


def remaindered(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """Whole numbers of either sign from their residues: one list for each modulus."""
    out, product = [0] * len(residues[0]), 1
    for row, p in zip(residues, moduli):
        inverse = pow(product, -1, p)
        out = [x + product * ((int(r) - x) * inverse % p) for x, r in zip(out, row)]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def derived(f: list[int]) -> list[int]:
    return [k * c for k, c in enumerate(f)][1:]


def divided(f: list[int], g: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder by a polynomial whose highest coefficient is 1."""
    rest, out = list(f), [0] * max(len(f) - len(g) + 1, 0)
    for k in range(len(out) - 1, -1, -1):
        out[k] = c = rest[k + len(g) - 1]
        for i, x in enumerate(g):
            rest[k + i] -= c * x
    return out, rest[:len(g) - 1]


def divisor_mod(f: list[int], g: list[int], p: int) -> list[int]:
    """Greatest common divisor modulo ``p``, highest coefficient 1."""
    a, b = ([x % p for x in h] for h in (f, g))
    while any(b):
        while not b[-1]:
            b.pop()
        inverse = pow(b[-1], -1, p)
        b = [x * inverse % p for x in b]
        while len(a) >= len(b):
            c, shift = a.pop(), len(a) + 1 - len(b)
            for i, x in enumerate(b[:-1]):
                a[shift + i] = (a[shift + i] - c * x) % p
        a, b = b, a
    return a


def common_divisor(f: list[int]) -> list[int]:
    """Greatest common divisor of ``f`` (highest coefficient 1) and its derivative, exactly. Its residues at primes where it has the least degree are put together until it divides both."""
    d, kept, moduli = derived(f), [], []
    for p in primes():
        g = divisor_mod(f, d, p)
        if len(g) == 1:
            return [1]
        if kept and len(g) > len(kept[0]):
            continue
        if kept and len(g) < len(kept[0]):
            kept, moduli = [], []
        kept.append(g)
        moduli.append(p)
        whole = remaindered(kept, moduli)
        if whole[-1] == 1 and not any(divided(f, whole)[1]) and not any(divided(d, whole)[1]):
            return whole
    raise ArithmeticError("no prime is left")


def value_sign(f: list[int], at: int, bits: int) -> int:
    """Sign of ``f`` at ``at / 2 ** bits``."""
    total = 0
    for k, c in enumerate(reversed(f)):
        total = total * at + (c << (bits * k))
    return (total > 0) - (total < 0)


def roots_beyond(f: list[int], at: int, bits: int) -> int:
    """How many roots lie beyond ``at / 2 ** bits``: sign changes of ``f`` moved there. Exact as all roots are real."""
    n = len(f) - 1
    moved = [c << (bits * (n - k)) for k, c in enumerate(f)]
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            moved[k] += at * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


@dataclass
class Root:
    """A root in ``(low, high] / 2 ** bits`` (a point if equal), how often it occurs, and its vectors as whole numbers of ``2 ** -unit``."""

    low: int
    high: int
    bits: int
    times: int = 1

    def at(self, bits: int) -> int:
        """Middle of the interval in units of ``2 ** -bits``."""
        return (self.low + self.high) << (bits - self.bits) >> 1

    def narrowed(self, f: list[int], bits: int) -> None:
        """Halve the interval until it is one unit of ``2 ** -bits`` long, by signs of ``f``, which has no other root in it and none twice."""
        self.low, self.high, self.bits = self.low << (bits - self.bits), self.high << (bits - self.bits), bits
        if self.low == self.high:
            return
        right = value_sign(f, self.high, bits)
        if not right:
            self.low = self.high
            return
        while self.high - self.low > 1:
            middle = (self.low + self.high) // 2
            sign = value_sign(f, middle, bits)
            if not sign:
                self.low = self.high = middle
                return
            if sign == right:
                self.high = middle
            else:
                self.low = middle


def largest_roots(f: list[int], most: int) -> list[Root]:
    """The largest positive roots of a characteristic polynomial (constant first) of a positive semidefinite matrix, falling, until they occur ``most`` times in all.

    Each is known to a part in 2 ** 80 and to a part in 2 ** 64 of its distance from its neighbours.
    """
    f = list(islice(f, next((k for k, c in enumerate(f) if c), len(f)), None))  # without the roots at zero
    if len(f) < 2:
        return []
    plain, rest = [], f
    while len(rest) > 1:  # every root once, then those that occur twice or more once, and so on
        g = common_divisor(rest)
        plain.append(divided(rest, g)[0])
        rest = g
    simple = plain[0]
    found, top = [], -f[-2]  # the sum of all roots
    bits = 0
    todo = [(0, top, len(simple) - 1, 0)]  # interval, roots beyond its ends
    while todo and sum(r.times for r in found) <= most:
        low, high, beyond_low, beyond_high = todo.pop()
        if beyond_low == beyond_high:
            continue
        if beyond_low - beyond_high == 1:
            root = Root(low, high, bits)
            root.times = sum(roots_beyond(g, low, bits) - roots_beyond(g, high, bits) for g in plain)
            found.append(root)
            continue
        if high - low < 2:
            bits += 16
            todo = [(a << 16, b << 16, x, y) for a, b, x, y in [*todo, (low, high, beyond_low, beyond_high)]]
            continue
        middle = (low + high) // 2
        inside = roots_beyond(simple, middle, bits)
        todo += [(low, middle, beyond_low, inside), (middle, high, inside, beyond_high)]
    unit = max(64, bits)
    while True:
        for r in found:
            r.narrowed(simple, unit)
        near = min([a.low - b.high for a, b in zip(found, found[1:])] + [found[-1].low])
        if near >> 80 >= 1:
            break
        unit += 64
    out, seen = [], 0
    for r in found:
        if seen < most:
            out.append(r)
        seen += r.times
    return out


class Shifted:
    """The matrix less a number on its diagonal, in triangles, in whole numbers of ``2 ** -unit``. A pivot of zero counts as one unit."""

    def __init__(self, matrix: np.ndarray, shift: int, unit: int):
        a, n = matrix << unit, len(matrix)
        a[np.arange(n), np.arange(n)] -= shift
        self.a, self.unit, self.order, self.factors = a, unit, [], []
        for k in range(n):
            pivot = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]] = a[[pivot, k]]
            self.order.append(pivot)
            a[k, k] = a[k, k] or 1
            factor = (a[k + 1:, k] << unit) // a[k, k]
            a[k + 1:, k + 1:] -= (factor[:, None] * a[k, k + 1:][None, :]) >> unit
            self.factors.append(factor)

    def solved(self, right: np.ndarray) -> np.ndarray:
        a, x, n = self.a, right.copy(), len(right)
        for k in range(n):
            x[[k, self.order[k]]] = x[[self.order[k], k]]
            x[k + 1:] -= (self.factors[k] * x[k]) >> self.unit
        for k in range(n - 1, -1, -1):
            x[k] = ((x[k] - (int((a[k, k + 1:] * x[k + 1:]).sum()) >> self.unit)) << self.unit) // a[k, k]
        return x


def united(x: np.ndarray, unit: int) -> np.ndarray:
    """A vector of length 1, its largest entry positive."""
    x = (x << unit) // max(map(abs, x))
    x = (x << unit) // isqrt(int((x * x).sum()))
    return x if x[max(range(len(x)), key=lambda i: abs(x[i]))] > 0 else -x


def vectors_of(matrix: list[list[int]], root: Root, rounds: int = 3) -> np.ndarray:
    """Unit vectors that span the null space of the matrix less ``root``, one a row, at right angles, as doubles."""
    whole = np.empty((len(matrix), len(matrix)), object)
    whole[:] = matrix
    unit = max(root.bits, 64) + 64
    shifted, out, draw = Shifted(whole, root.at(unit), unit), [], Random(1)
    for _ in range(root.times):
        x = np.array([draw.getrandbits(unit) - (1 << (unit - 1)) for _ in matrix], object)
        for _ in range(rounds):
            x = united(shifted.solved(united(x, unit)), unit)
            for _ in range(2):
                for other in out:
                    x = x - (other * (int((x * other).sum()) >> unit) >> unit)
            x = united(x, unit)
        out.append(x)
    return np.array([[int(v) / (1 << unit) for v in x] for x in out])
