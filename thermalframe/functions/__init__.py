"""Row-wise column expressions: cleaning rules, features, physics residuals."""
