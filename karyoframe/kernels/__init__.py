"""Sequential optimisation over one chromosome or one cluster: numpy in, numpy out, without Spark."""
