"""Models: fitted on bounded or summed-up data, applied by column expressions or Arrow batches.

scikit-learn, statsmodels, arch, xgboost and torch are not used; these are own implementations and no parity with those libraries is claimed.
"""
