"""Plan documents, binding, compilation, recipes and the registered queries."""
