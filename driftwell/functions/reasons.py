"""Why a row of a model is not valid."""

# Reasons as reported, which users compare with results they have.
OU_SHORT = "At least 20 finite observations are required."
OU_NOT_FINITE = "Input contains NaN or infinite observations."
OU_FLAT = "Input variance is effectively zero."
OU_NOT_REVERTING = "AR(1) coefficient is not strictly inside the mean-reverting interval (0, 1)."
OU_NO_INNOVATION = "AR(1) innovation variance is effectively zero."
PAIR_SHORT = "Insufficient prior complete observations."
PAIR_MISSING = "Missing target or peer price in the prior window or current observation."
PAIR_FLAT = "Prior-window spread standard deviation is effectively zero."
PCA_SHORT = "Insufficient prior complete observations."
PCA_MISSING = "Missing return in training window or current observation."
PCA_FLAT_RETURN = "A training return standard deviation is effectively zero."
PCA_FLAT_RESIDUAL = "A PCA residual standard deviation is effectively zero."
HEDGE_SHORT = "Insufficient historical observations."
HEDGE_NONE = "No valid OU fit in hedge-ratio grid."
NOT_POSITIVE = "prices must be strictly positive"
UNKNOWN = "missing ticker"
