"""The composed flows: timeline build, snapshot features, postpartum features, training, fusion."""
