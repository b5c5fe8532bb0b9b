"""functions of the review-signal analytics engine."""
