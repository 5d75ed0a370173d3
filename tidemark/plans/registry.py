"""The factors that the leverage analysis knows by key: topic and the frame of (code, ts_ms, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

# fixed values: the keys and topics of the bindings; then the query and, where it holds several, its column
BINDINGS = {
    "low_freq_return": ("kline/ret_lowfreq_mu10", "low_freq_return", None),
    "ar1_return": ("kline/ar1_return_coeff", "ar1_return", "ar1_return_coeff"),
    "high_volume_remaining": ("kline/vol_high_remaining", "high_volume_remaining", None),
    "volume_ar_forecast": ("kline/vol_ar1_pred_ratio", "volume_ar_forecast", "vol_ar1_pred_ratio"),
    "volume_price_structure_corr": ("kline/ret_logvol_corr", "ret_logvol_corr", "ret_logvol_corr"),
    "volume_price_structure_pca1": ("kline/pv_pca1_ret_loading", "volume_price_pca1", None),
    "kalman_forecast_z": ("kline/kalman_forecast_z", "kalman_forecast_z", None),
    "wls_drift_z": ("kline/wls_drift_z", "wls_drift_z", "wls_drift_z"),
    "hmm2_logodds": ("kline/hmm2_logodds", "hmm2_logodds", None),
    "bayes_drift_logodds": ("kline/bayes_drift_logodds", "bayes_drift_logodds", "bayes_drift_logodds"),
    "wavelet_trend_energy": ("wave_trend/energy_ratio", "wavelet_trend_energy", None),
    "haar_wavelet_trend": ("kline_new/haar_trend_energy", "haar_wavelet_trend", None),
}


def resolve(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """(topic, code, ts_ms, value) of a bound factor; ValueError for an unknown key."""
    if key not in BINDINGS:
        raise ValueError(f"unknown factor {key!r}; known: {', '.join(BINDINGS)}")
    topic, query, column = BINDINGS[key]
    df = catalog.QUERIES[query](spark, sf_dir)
    own = df.filter(F.col("topic") == topic) if column is None else df.withColumnRenamed(column, "value")
    return own.select(F.lit(topic).alias("topic"), "code", "ts_ms", "value")
