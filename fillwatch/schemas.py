"""Column contracts of the tables the operators exchange."""

from __future__ import annotations

TRADES_DDL = "market STRING, wallet STRING, ts BIGINT, price DOUBLE, size DOUBLE, side STRING, tx_hash STRING"
#: Fields of an append-only trade capture, one JSON object per line.
CAPTURE_DDL = ("timestamp STRING, price STRING, size STRING, wallet STRING, side STRING, "
               "transaction_hash STRING, condition_id STRING, asset_id STRING")
SCORES_DDL = ("ts DOUBLE, tx_hash STRING, market STRING, wallet STRING, p_z DOUBLE, p_v DOUBLE, x_mean DOUBLE")
REPLICATE_DDL = (
    "seed BIGINT, schema_version INT, L INT, ranks MAP<STRING,INT>, hits90 MAP<STRING,BOOLEAN>, "
    "theta_hits90 ARRAY<BOOLEAN>, z_auc DOUBLE, "
    "flags STRUCT<vem_converged: BOOLEAN, laplace_fallback: BOOLEAN, failed: BOOLEAN, error: STRING>, "
    "elapsed_s DOUBLE, size STRUCT<K: INT, T: INT, n_wallets: INT>, prior MAP<STRING,DOUBLE>")
MANIFEST_DDL = (
    "schema_version INT, case STRING, "
    "markets ARRAY<STRUCT<condition_id: STRING, slug: STRING, question: STRING, role: STRING>>, "
    "analysis_window STRUCT<start: STRING, `end`: STRING>, "
    "wallet_anchor STRUCT<handle: STRING, address: STRING, address_pattern: STRING>, "
    "doj_timeline ARRAY<STRUCT<ts: STRING, label: STRING, source: STRING>>")
