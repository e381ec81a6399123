"""Sets of tables for export by ``writers.write_tables``: components, monitoring, one regression, many regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import mlr, monitor, multi, pca, validation
from statloom.operators.mlr import Regression
from statloom.operators.monitor import Monitor
from statloom.operators.pca import PcaModel


def loadings(df: DataFrame, model: PcaModel) -> DataFrame:
    """(variable, one column a component)."""
    rows = [(v, *map(float, model.loadings[i])) for i, v in enumerate(model.variables)]
    return df.sparkSession.createDataFrame(rows, ", ".join(["variable string", *[f"{n} double" for n in model.names]]))


def pca_tables(df: DataFrame, model: PcaModel, keep: list[str]) -> dict[str, DataFrame]:
    """Scores, Loadings, Explained_Variance, Contributions, Diagnostics and Limits."""
    return {
        "Scores": pca.scores(df, model, keep), "Loadings": loadings(df, model), "Explained_Variance": pca.variance_table(model, df), "Contributions": pca.contributions(model, df),
        "Diagnostics": pca.diagnostics(df, model, keep), "Limits": pca.limits(df, model),
    }


def monitor_tables(df: DataFrame, model: Monitor, keep: list[str]) -> dict[str, DataFrame]:
    """Summary, Limits, Results (T2, Q, fault of each row), Faults and Contributions (shares of each variable in T2 and Q)."""
    results = monitor.faults(df, model, keep)
    return {
        "Summary": monitor.summary(df, model), "Limits": monitor.limits_table(df, model), "Results": results, "Faults": results.where("fault <> 'none'"),
        "Contributions": monitor.variable_shares(df, model, keep),
    }


def mlr_tables(df: DataFrame, model: Regression, keep: list[str]) -> dict[str, DataFrame]:
    """Summary, Coefficients, Fitted, CV_Predictions, Diagnostics, VIF and Dispersion."""
    rows = mlr.diagnostics(df, model, keep)
    coefficients = mlr.coefficients(model, df)
    return {
        "Summary": mlr.summary(df, model), "Coefficients": coefficients, "Fitted": rows.select(*keep, "observed", "fitted", "residual"), "CV_Predictions": rows.select(*keep, "observed", "cv_predicted", "cv_residual"),
        "Diagnostics": rows.select(*keep, "residual", "leverage", (F.col("leverage") > 2.0 * len(model.terms) / model.n).alias("high")),
        "VIF": coefficients.where("term <> 'Intercept'").select("term", "vif", mlr.vif_band(F.col("vif")).alias("band")), "Dispersion": validation.dispersion(df, model),
    }


def multi_tables(df: DataFrame, models: dict[str, Regression | None], keep: list[str]) -> dict[str, DataFrame]:
    """Summary and Coefficients_Comparison of all responses; Coef_ and Fitted_ of each, Error_ for one that could not be fitted."""
    out = {"Summary": multi.summaries(df, models), "Coefficients_Comparison": multi.comparison(df, models)}
    for y, model in models.items():
        if model is None:
            out[f"Error_{y}"] = df.sparkSession.createDataFrame([(y, "terms are linearly dependent")], "response string, error string")
            continue
        out[f"Coef_{y}"] = mlr.coefficients(model, df)
        out[f"Fitted_{y}"] = mlr.diagnostics(df, model, keep).select(*keep, "observed", "fitted", "residual")
    return out
