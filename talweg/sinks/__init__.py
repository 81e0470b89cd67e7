"""Writers of vector layers and rainfall-runoff model files."""
