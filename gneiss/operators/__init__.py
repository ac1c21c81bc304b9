"""gneiss.operators"""
