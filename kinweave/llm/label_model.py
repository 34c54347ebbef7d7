"""A generative label model: heuristic votes on pairs, whose accuracies and correlations are learned without labels.

A vote is a level from 1 up, or 0 where the function abstains; abstaining tells nothing. Given the kind of a pair, its
votes are independent. There is one kind of match and there are several of non-match: that is how correlated errors are
learned, such as twins, for whom surname, birth and address agree at once. Kinds that compare the same thing by a vote, such
as the birth of one person, or the first names of two, have its distribution in common; that is what makes the kinds differ
in more than where they start. Shares and distributions are fitted by expectation-maximisation on the counts of vote
patterns, of which there are as many as the levels allow, however many pairs were voted on.
"""

from __future__ import annotations

import numpy as np

#: Pairs that a starting distribution counts as, and what a level has that starts from 0, however many pairs say otherwise.
PSEUDO, RARE = 20.0, 0.001


class LabelModel:
    """``start``: for every kind, the match first, a distribution over the levels from 1 up of every vote. ``ties``: for
    every vote, a number for each kind; kinds with one number have one distribution, which starts from their mean. A level of
    0 is one that a kind does not have by what it means, such as one birth of two people: it stays at RARE. ``held``: votes and numbers whose distribution is not learned."""

    def __init__(self, start: dict[str, list[list[float]]], shares: list[float], ties: list[list[int]] | None = None, held: set[tuple[int, int]] = frozenset()) -> None:
        self.kinds = list(start)
        self.shares = np.array(shares, float) / sum(shares)
        votes = len(next(iter(start.values())))
        self.ties = [np.array(t) for t in ties or [list(range(len(self.kinds)))] * votes]
        given = [np.array([start[k][v] for k in self.kinds], float) for v in range(votes)]
        self.first = [np.stack([g[t == k].mean(axis=0) for k in range(t.max() + 1)]) for g, t in zip(given, self.ties)]
        self.never = [g == 0 for g in self.first]
        self.held = held
        self.first = [self._rare(g, never) for g, never in zip(self.first, self.never)]
        self.tables = [g[t] for g, t in zip(self.first, self.ties)]

    @staticmethod
    def _rare(table: np.ndarray, never: np.ndarray, rare: np.ndarray | float = RARE) -> np.ndarray:
        table = np.where(never, 0.0, table)
        table = table / table.sum(axis=1, keepdims=True) * (1 - rare * never.sum(axis=1, keepdims=True))
        return np.where(never, rare, table)

    def hold(self, other: LabelModel, groups: list[tuple[int, int]]) -> None:
        """These distributions are the other model's and are not learned."""
        for v, k in groups:
            self.first[v][k] = other.tables[v][self.ties[v] == k][0]
            self.tables[v] = self.first[v][self.ties[v]]
        self.held = {*self.held, *groups}

    def responsibilities(self, votes: np.ndarray) -> np.ndarray:
        """Probability of every kind, for each pattern."""
        log = np.log(self.shares)[None, :].repeat(len(votes), axis=0)
        for v, table in enumerate(self.tables):
            known = votes[:, v] > 0
            log[known] += np.log(table[:, votes[known, v] - 1]).T
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of a match for each pattern."""
        return self.responsibilities(votes)[:, 0]

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 2000) -> LabelModel:
        """Until no more than one pair in a million changes its kind."""
        before = None
        for _ in range(rounds):
            weight = self.responsibilities(votes) * counts[:, None]
            self.shares = weight.sum(axis=0) + 1
            self.shares /= self.shares.sum()
            for v, (first, tie) in enumerate(zip(self.first, self.ties)):
                table = first * PSEUDO
                known = votes[:, v] > 0
                of = np.stack([weight[known][:, tie == k].sum(axis=1) for k in range(len(first))], axis=1)
                np.add.at(table.T, votes[known, v] - 1, of)
                groups = np.array([self.shares[tie == k].sum() for k in range(len(first))])
                made = self._rare(table, self.never[v], RARE * np.minimum(1, self.shares[0] / groups)[:, None])
                for k in [k for at, k in self.held if at == v]:
                    made[k] = first[k]
                self.tables[v] = made[tie]
            if before is not None and np.abs(weight - before).sum() < 1e-6 * counts.sum():
                break
            before = weight
        return self
