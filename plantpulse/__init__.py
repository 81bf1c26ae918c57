"""plantpulse: condition monitoring of industrial equipment on Spark."""
