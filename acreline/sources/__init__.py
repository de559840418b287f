"""acreline.sources"""
