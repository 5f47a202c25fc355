"""Members that WinZip encrypted with AES. Keys are derived and texts combined in Arrow batches; the
cipher itself is Spark's: the key stream of its counter mode is AES of the counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: rounds of the key derivation, bytes of verifier and authentication code.
ROUNDS, VERIFIER, CODE = 1000, 2, 10


def unlock(members: DataFrame, password: str) -> DataFrame:
    """members(content, error) of `archive_content` with what was AES-encrypted in the clear. error then
    is null, `password` for a wrong one, or `damaged` where the authentication code differs."""
    secret = password.encode()

    @F.pandas_udf("struct<key:binary,counters:binary,mac_key:binary,ok:boolean>")
    def prepare(content: pd.Series) -> pd.DataFrame:
        import hashlib

        rows = []
        for c in content:
            if c is None:
                rows.append((None, None, None, None))
                continue
            strength = c[0]
            salt_n, key_n = 4 * (strength + 1), 8 * (strength + 1)
            salt, check = c[3 : 3 + salt_n], c[3 + salt_n : 3 + salt_n + VERIFIER]
            derived = hashlib.pbkdf2_hmac("sha1", secret, salt, ROUNDS, 2 * key_n + VERIFIER)
            blocks = -(-(len(c) - 3 - salt_n - VERIFIER - CODE) // 16)
            counters = b"".join(i.to_bytes(16, "little") for i in range(1, blocks + 1))
            rows.append((derived[:key_n], counters, derived[key_n : 2 * key_n], derived[2 * key_n :] == check))
        return pd.DataFrame(rows, columns=["key", "counters", "mac_key", "ok"])

    @F.pandas_udf("struct<content:binary,error:string>")
    def finish(content: pd.Series, stream: pd.Series, mac_key: pd.Series, ok: pd.Series) -> pd.DataFrame:
        import hashlib
        import hmac
        import zlib

        import numpy as np

        rows = []
        for c, s, m, fine in zip(content, stream, mac_key, ok, strict=True):
            if c is None or not fine:
                rows.append((None, "password" if c is not None else None))
                continue
            data, code = c[3 + 4 * (c[0] + 1) + VERIFIER : -CODE], c[-CODE:]
            if hmac.new(m, data, hashlib.sha1).digest()[:CODE] != code:
                rows.append((None, "damaged"))
                continue
            plain = (np.frombuffer(data, np.uint8) ^ np.frombuffer(s, np.uint8)[: len(data)]).tobytes()
            rows.append((zlib.decompress(plain, -15) if int.from_bytes(c[1:3], "little") == 8 else plain, None))
        return pd.DataFrame(rows, columns=["content", "error"])

    locked = F.col("error") == "aes"
    keyed = members.withColumn("_k", prepare(F.when(locked, F.col("content"))))
    stream = F.when(F.col("_k.ok"), F.aes_encrypt("_k.counters", "_k.key", F.lit("ECB"), F.lit("PKCS")))
    opened = keyed.withColumn("_o", finish(F.when(locked, F.col("content")), stream, F.col("_k.mac_key"), F.col("_k.ok")))
    clear = F.coalesce(locked, F.lit(False))
    return opened.withColumns({"content": F.when(clear, F.col("_o.content")).otherwise(F.col("content")), "error": F.when(clear, F.col("_o.error")).otherwise(F.col("error"))}).drop("_k", "_o")
