"""Table operators: order-dependent, statistical, drift, rule and model operators."""
