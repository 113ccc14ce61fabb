"""Table functions for SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..spec import P61


class ShamirShare:
    """shamir_share(secret, n, t, key): a row (party, y) for each party 1..n. Masks are keyed hashes, the
    same as those of the share operator, so both give the same shares. A null secret gives no rows."""

    def eval(self, secret: int, n: int, t: int, key: str) -> Iterator[tuple[int, int]]:
        if secret is None:
            return
        if not 0 <= t < n:
            raise ValueError("n parties must hold t + 1 shares at least")
        masks = [int(hashlib.sha256(f"share|{key}|{k}".encode()).hexdigest()[:15], 16) for k in range(1, t + 1)]
        for party in range(1, n + 1):
            yield party, (secret + sum(m * pow(party, k, P61) for k, m in enumerate(masks, 1))) % P61


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, for FROM and LATERAL."""
    spark.udtf.register("shamir_share", udtf(ShamirShare, returnType="party int, y bigint", useArrow=True))
