"""Training-data operators: ten corpus jobs, each independent of the spike-train modules."""
