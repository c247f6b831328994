"""Observed peaks to scattering vectors: a pure projection, the same on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diffract import scale_norm_k_, tth_eta_
from ..functions.geometry import lab_to_sample_
from ..functions.linalg import Stage, norm, sub
from .forward import Setup, _vector


def peaks_to_q(peaks: DataFrame, setup: Setup) -> DataFrame:
    """``peaks`` (sc, fc, omega) with tth, eta, ds and the sample-frame vector qx, qy, qz. Null angles or places give nulls."""
    at1, at2, at0 = setup.detector.basis()
    s = Stage(peaks)
    # pixels lie on a plane: the place is that of pixel (0, 0) plus multiples of the two pixel steps
    lab = s.put(_lab=tuple(F.lit(z) + F.col("sc") * (a - z) + F.col("fc") * (b - z) for a, b, z in zip(at1, at2, at0, strict=True)))
    k_in = scale_norm_k_(_vector(a + b for a, b in zip(setup.k0, (0.0, setup.ky, setup.kz), strict=True)), F.lit(float(setup.wavelength)))
    k_out = s.put(_k=scale_norm_k_(lab, F.lit(float(setup.wavelength))))
    q = s.put(_q=sub(k_out, k_in))
    tth, eta = tth_eta_(q, F.lit(float(setup.wavelength)))
    s.put(tth=tth, eta=eta, ds=norm(q), _s=lab_to_sample_(q, F.col("omega"), setup.wedge, setup.chi, 0, 0))
    return s.df.select(*peaks.columns, "tth", "eta", "ds", *(F.col(f"_s_{c}").alias(f"q{c}") for c in "xyz"))
